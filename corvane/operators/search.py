"""Ranked search: cosine TF-IDF boosted by PageRank, with metadata and snippets for the results alone."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import SearchOptions
from corvane.functions.html import extract_pages
from corvane.functions.text import ASCII, idf, snippet, tf_weight, tokenize
from corvane.functions.urls import host_of
from corvane.sources.tables import clean_postings, current_pages, latest


def check_request(q: str, limit: int | None, options: SearchOptions = SearchOptions()) -> int:
    """The limit to use; raises ValueError for a blank or overlong query and for limits outside 1..max."""
    if not q or not q.strip():
        raise ValueError("the query is empty")
    if len(q) > options.max_query_chars:
        raise ValueError("the query is too long")
    limit = options.default_limit if limit is None else limit
    if not 1 <= limit <= options.max_limit:
        raise ValueError(f"limit must lie in 1..{options.max_limit}")
    return limit


def query_terms(spark: SparkSession, q: str) -> DataFrame:
    """(term, q_count) of a query string; as many rows as it has distinct terms."""
    return spark.createDataFrame(sorted(Counter(tokenize(q)).items()), "term string, q_count int")


def postings_of_terms(postings: DataFrame, words: list[str]) -> DataFrame:
    """Valid postings of some words in clean form, from a table of raw ones: only what can be one of them is folded."""
    plain = F.col("term").rlike(ASCII)
    near = postings.where(F.when(plain, F.lower(F.regexp_replace("term", r"^\s+|\s+$", "")).isin(words)).otherwise(True))
    return clean_postings(near).where(F.col("term").isin(words))


def candidates(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings of any query term. The query's terms, at most some hundred rows by its length limit, are broadcast."""
    return postings.join(F.broadcast(terms), "term")


def total_matches(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: pages that hold any query term, before scores and limits."""
    return candidates(terms, postings).agg(F.countDistinct("page_id").alias("total_matches"))


def rank(terms: DataFrame, postings: DataFrame, freq: DataFrame, pages: DataFrame, total_docs: DataFrame, limit: int, alpha: float) -> DataFrame:
    """(page_id, score, pagerank): the best pages, scores above 0 only; ties go to the smaller id.

    A page's norm that is null or 0 doesn't divide; a missing pagerank counts as 0; a term without statistics has
    doc_freq 0. Pages are joined after scores are summed up, the limit is a top-k, not a sort.
    """
    known = F.broadcast(terms.join(freq, "term", "left").withColumn("doc_freq", F.coalesce("doc_freq", F.lit(0))).crossJoin(F.broadcast(total_docs.select("n"))))
    weight = tf_weight(F.col("tf")) * idf(F.col("doc_freq"), F.col("n")) * F.col("q_count")
    raw = postings.join(known, "term").groupBy("page_id").agg(F.sum(weight).alias("raw"))
    scored = raw.join(pages.select(F.col("id").alias("page_id"), "tfidf_norm", "pagerank"), "page_id", "left")
    pr = F.when(F.isnan("pagerank") | F.col("pagerank").isNull(), F.lit(0.0)).otherwise(F.col("pagerank"))
    cosine = F.when(F.col("tfidf_norm") > 0, F.col("raw") / F.col("tfidf_norm")).otherwise(F.col("raw"))
    final = scored.where(cosine > 0).select("page_id", (cosine * (1 + alpha * pr)).alias("score"), pr.alias("pagerank"))
    return final.orderBy(F.desc("score"), F.asc("page_id")).limit(limit)


def search(
    spark: SparkSession, q: str, postings: DataFrame, freq: DataFrame, scored: DataFrame, pages: DataFrame, bodies: DataFrame,
    total_docs: DataFrame, limit: int | None = None, options: SearchOptions = SearchOptions(),
) -> DataFrame:
    """(page_id, url, title, domain, score, pagerank, snippet) of the best pages, scores rounded to four places.

    `scored` has (id, tfidf_norm, pagerank) of the current pages; `pages` and `bodies` are the stored tables, of which
    only the rows of the results are read: their ids and keys, as many as the limit, are filters of the scans. A query
    of stop words alone gives no rows. Results without a page row are dropped, those without a body have an empty snippet.
    """
    limit = check_request(q, limit, options)
    terms = query_terms(spark, q)
    top = rank(terms, postings, freq, scored, total_docs, limit, options.alpha).collect()  # at most `limit` rows
    first = spark.createDataFrame(top, "page_id long, score double, pagerank double")
    meta = current_pages(pages.where(F.col("id").isin([r.page_id for r in top])), "url", "title", "domain", "minio_key")
    hits = meta.withColumnRenamed("id", "page_id").collect()
    known = spark.createDataFrame(hits, "page_id long, url string, title string, domain string, minio_key string").join(F.broadcast(first), "page_id")
    stored_as = sorted({r.minio_key for r in hits if r.minio_key is not None})
    body = latest(bodies.where(F.col("minio_key").isin(stored_as)), "minio_key", "stored_at", "html")
    texts = extract_pages(F.broadcast(known).join(body, "minio_key").select(F.col("page_id").alias("id"), "html", "url")).select(F.col("id").alias("page_id"), "text")
    return known.join(F.broadcast(texts), "page_id", "left").select(
        "page_id", "url", "title", "domain", F.round("score", 4).alias("score"), F.round("pagerank", 4).alias("pagerank"),
        F.coalesce(snippet(F.col("text"), sorted({*tokenize(q)}), options.snippet_window), F.lit("")).alias("snippet"),
    )


def stats(index_stats: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: total_docs, total_terms (0 if unknown) and last_crawl_at as ISO 8601 or null."""
    pick = lambda key: F.coalesce(F.max(F.when(F.col("key") == key, F.col("value"))).cast("long"), F.lit(0)).alias(key)
    last = pages.agg(F.date_format(F.max("last_crawled_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("last_crawl_at"))
    return index_stats.agg(pick("total_docs"), pick("total_terms")).crossJoin(last)


def shown(hits: DataFrame) -> DataFrame:
    """hits with shown_title and shown_domain: the url for want of a title, its host or else itself for want of a domain."""
    url = F.col("url")
    return hits.withColumn("shown_title", F.coalesce(F.nullif("title", F.lit("")), url)).withColumn(
        "shown_domain", F.coalesce(F.nullif("domain", F.lit("")), host_of("url"), url)
    )


def as_response(q: str, hits: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: the JSON body of a search response, without the time it took. Nulls are written, numbers in plain decimals."""
    plain = lambda c: F.col(c).cast("decimal(18,4)").alias(c)
    rows = hits.select(F.struct("url", "title", "snippet", plain("score"), "domain", plain("pagerank")).alias("r"), "score", "page_id")
    listed = rows.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "page_id", "r"))).alias("l"))  # at most `limit` rows
    body = F.struct(F.lit(q).alias("query"), F.col("total_matches"), F.transform("l", lambda x: x["r"]).alias("results"))
    return listed.crossJoin(matches).select(F.to_json(body, {"ignoreNullFields": "false"}).alias("response"))
