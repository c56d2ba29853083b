"""Queries on tokens, the inverted index and its statistics, over documents (doc_id stands for the page)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import index
from corvane.operators.crawl import dense_ids
from corvane.plans.registry import NARROW, NUM_PAGES, POSTS, WIDE, query
from corvane.session import settle, spread
from corvane.sources.tables import clean_postings, current_pages, table

WORDS = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def folded_sql(text: str) -> str:
    """Compatibility folding of the characters that occur in the tables, as SQL has no NFKC."""
    wide, narrow = WIDE + "　 ", NARROW.replace("'", "''") + "  "
    special = f"translate({text}, '{wide}', '{narrow}')"
    for a, b in (("ﬁ", "fi"), ("½", "1⁄2"), ("①", "1"), ("…", "..."), ("²", "2"), ("Ω", "Ω")):
        special = f"replace({special}, '{a}', '{b}')"
    return f"lower(nfc_normalize({special}))"


def tokens_sql(source: str = "documents", text: str = "text", no: str = "") -> str:
    return f"""raw{no} AS (SELECT doc_id, unnest(regexp_extract_all({folded_sql(text)}, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+|\\p{{Nd}}+')) AS w FROM {source}),
    kept{no} AS (SELECT doc_id, w FROM raw{no} WHERE length(w) >= 2 AND w NOT IN ({WORDS})),
    tok{no} AS (SELECT doc_id, term FROM (SELECT doc_id, CASE WHEN regexp_matches(w, '^\\p{{Nd}}') THEN w
        WHEN w LIKE '%ies' AND length(w) >= 7 THEN w[:-4] || 'y' WHEN w LIKE '%ing' AND length(w) >= 7 THEN w[:-4]
        WHEN w LIKE '%ed' AND length(w) >= 6 THEN w[:-3] WHEN w LIKE '%es' AND length(w) >= 6 THEN w[:-3]
        WHEN w LIKE '%s' AND length(w) >= 5 THEN w[:-2] ELSE w END AS term FROM kept{no}) WHERE length(term) >= 2),
    post{no} AS (SELECT term, doc_id AS page_id, count(*) AS tf FROM tok{no} GROUP BY 1, 2)"""


TOKENS = tokens_sql()
FREQ = "freq AS (SELECT term, count(*) AS doc_freq FROM post GROUP BY 1)"


def docs(spark, where):
    return spread(table(spark, where, "documents"))


def postings_of(spark, where):
    return index.build_postings(docs(spark, where), "doc_id", "text")


@query("tokenize_stem", f"WITH {TOKENS} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms, min(term) AS first_term FROM tok GROUP BY 1")
def tokenize_stem(spark, where):
    folded = T.folded_text(docs(spark, where).select("doc_id", "text"), "text")
    rows = folded.select("doc_id", T.tokens_of(F.col("_folded")).alias("t")).where(F.size("t") > 0)
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), F.array_min("t").alias("first_term"))


@query("postings", f"WITH {TOKENS} SELECT term, page_id, tf FROM post")
def postings(spark, where):
    return postings_of(spark, where)


@query("doc_freq", f"WITH {TOKENS}, {FREQ} SELECT term, doc_freq FROM freq")
def doc_freq(spark, where):
    return index.document_frequencies(postings_of(spark, where))


@query(
    "tf_idf_weights",
    f"""WITH {TOKENS}, {FREQ}, n AS (SELECT count(*)::DOUBLE AS n FROM documents)
    SELECT term, page_id, round((1 + ln(tf)) * (ln((1 + n) / (1 + doc_freq)) + 1), 6) AS weight FROM post JOIN freq USING (term), n""",
)
def tf_idf_weights(spark, where):
    n = docs(spark, where).agg(F.count("*").alias("n"))
    w = index.weighted_postings(postings_of(spark, where), n)
    return w.select("term", "page_id", F.round("weight", 6).alias("weight"))


@query(
    "doc_norm_snapshot",
    f"""WITH {TOKENS}, {FREQ}, n AS (SELECT count(*)::DOUBLE AS n FROM documents)
    SELECT page_id, round(sqrt(sum(pow((1 + ln(tf)) * (ln((1 + n) / (1 + doc_freq)) + 1), 2))), 6) AS norm
    FROM post JOIN freq USING (term), n GROUP BY 1""",
)
def doc_norm_snapshot(spark, where):
    n = docs(spark, where).agg(F.count("*").alias("n"))
    return index.norms_snapshot(postings_of(spark, where), n).select("page_id", F.round("norm", 6).alias("norm"))


@query(
    "doc_norm_incremental",
    f"""WITH {TOKENS}, s AS (SELECT doc_id AS page_id, row_number() OVER (ORDER BY fetched_at ASC NULLS FIRST, doc_id) AS seq FROM documents),
    r AS (SELECT page_id, tf, row_number() OVER (PARTITION BY term ORDER BY seq) AS df, greatest(seq - 1, 1)::DOUBLE AS n FROM post JOIN s USING (page_id))
    SELECT page_id, round(sqrt(sum(pow((1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1), 2))), 6) AS norm FROM r GROUP BY 1""",
)
def doc_norm_incremental(spark, where):
    """Documents indexed in the order in which they were fetched, those without a time first."""
    numbered = dense_ids(docs(spark, where).select("doc_id", "fetched_at"), ["fetched_at", "doc_id"], F.lit(1))
    seq = numbered.select(F.col("doc_id").alias("page_id"), F.col("id").alias("seq"))
    return index.norms_incremental(postings_of(spark, where), seq).select("page_id", F.round("norm", 6).alias("norm"))


@query(
    "index_stats",
    f"""WITH {NUM_PAGES} SELECT 'total_docs' AS key, count(last_indexed_hash)::DOUBLE AS value FROM cur
    UNION ALL SELECT 'total_terms', count(*)::DOUBLE FROM terms WHERE doc_freq > 0""",
)
def index_stats(spark, where):
    return index.index_stats(current_pages(table(spark, where, "pages"), "last_indexed_hash"), table(spark, where, "terms"))


@query(
    "pages_needing_index",
    f"""WITH {NUM_PAGES} SELECT id, content_hash FROM cur WHERE status = 'crawled' AND minio_key IS NOT NULL AND content_hash IS NOT NULL
    AND (last_indexed_hash IS NULL OR last_indexed_hash <> content_hash) ORDER BY last_crawled_at ASC NULLS FIRST, id LIMIT 25""",
)
def needing_index(spark, where):
    columns = ("status", "minio_key", "content_hash", "last_indexed_hash", "last_crawled_at")
    return index.pages_needing_index(current_pages(table(spark, where, "pages"), *columns), 25).select("id", "content_hash")


# Second version of each document: the text without its last paragraph.
def _second():
    """Without a paragraph break the text stays whole."""
    parts = F.split("text", "\n\n")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "\n\n")).otherwise(F.col("text"))


_SECOND_SQL = "(SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) || chr(10) || '%' THEN array_to_string(string_split(text, chr(10) || chr(10))[:-2], chr(10) || chr(10)) ELSE text END AS text FROM documents)"


def _reindexed(spark, where):
    old = settle(postings_of(spark, where))  # read by reindex and counted here
    changed = docs(spark, where).withColumn("text", _second())
    fresh = index.build_postings(changed, "doc_id", "text")
    return index.reindex(old, index.document_frequencies(old), fresh, changed.select(F.col("doc_id").alias("page_id")))


_TWO = f"{TOKENS}, {tokens_sql(_SECOND_SQL, no='2')}"


@query("reindex_postings", f"WITH {_TWO} SELECT term, page_id, tf FROM post2")
def reindex_postings(spark, where):
    return _reindexed(spark, where)[0]


@query(
    "reindex_doc_freq",
    f"WITH {_TWO}, {FREQ}, freq2 AS (SELECT term, count(*) AS n FROM post2 GROUP BY 1) SELECT term, coalesce(n, 0) AS doc_freq FROM freq LEFT JOIN freq2 USING (term)",
)
def reindex_doc_freq(spark, where):
    return _reindexed(spark, where)[1]


@query(
    "terms_stale",
    f"""WITH {POSTS}, f AS (SELECT term, count(*) AS n FROM posts GROUP BY 1)
    SELECT term, doc_freq, coalesce(n, 0) AS counted FROM terms LEFT JOIN f USING (term) WHERE doc_freq <> coalesce(n, 0)""",
)
def terms_stale(spark, where):
    """Terms whose stored doc_freq isn't what the postings say."""
    counted = index.document_frequencies(clean_postings(table(spark, where, "postings"))).withColumnRenamed("doc_freq", "n")
    joined = table(spark, where, "terms").join(counted, "term", "left").withColumn("counted", F.coalesce("n", F.lit(0)))
    return joined.where(F.col("doc_freq") != F.col("counted")).select("term", "doc_freq", "counted")


@query(
    "snippet_hit",
    """WITH t AS (SELECT doc_id, text, length(text) AS n, least(CASE WHEN strpos(lower(text), 'archive') > 0 THEN strpos(lower(text), 'archive') END,
        CASE WHEN strpos(lower(text), 'map') > 0 THEN strpos(lower(text), 'map') END) - 1 AS p FROM documents WHERE text IS NOT NULL AND text <> '')
    SELECT doc_id, trim(regexp_replace(CASE WHEN p IS NULL THEN substr(text, 1, 320) ELSE
        CASE WHEN p > 80 THEN '… ' ELSE '' END || substr(text, greatest(0, p - 80) + 1, least(n, p + 160) - greatest(0, p - 80)) ||
        CASE WHEN least(n, p + 160) < n THEN ' …' ELSE '' END END, '[\\s\\v\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS snippet FROM t
    UNION ALL SELECT doc_id, '' FROM documents WHERE text IS NULL OR text = ''""",
)
def snippet_hit(spark, where):
    return docs(spark, where).select("doc_id", T.snippet(F.col("text"), ["archive", "map"]).alias("snippet"))


@query(
    "content_hashes",
    "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1",
)
def content_hashes(spark, where):
    hashed = docs(spark, where).where(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
