"""The inverted index: postings, document frequencies, norms, statistics, and their maintenance by difference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import idf, term_counts, tf_weight
from corvane.operators.skew import heavy_keys, salted_join
from corvane.session import settle


def build_postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, page_id, tf), unique by (term, page_id); documents without tokens have none."""
    return term_counts(docs, key, text).select("term", F.col(key).alias("page_id"), "tf")


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("doc_freq"))


def index_stats(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, value): total_docs counts pages that were ever indexed, total_terms terms in use. Always two rows."""
    docs = pages.agg(F.count("last_indexed_hash").cast("double").alias("value"))
    used = terms.agg(F.count_if(F.col("doc_freq") > 0).cast("double").alias("value"))
    return docs.select(F.lit("total_docs").alias("key"), "value").unionByName(used.select(F.lit("total_terms").alias("key"), "value"))


def weighted_postings(postings: DataFrame, total_docs: DataFrame) -> DataFrame:
    """postings with doc_freq and weight = (1 + ln tf) * idf; total_docs is one row with column n.

    Frequent terms are salted: a term may hold a large part of all postings.
    """
    postings = settle(postings)
    freq = document_frequencies(postings)
    heavy = heavy_keys(freq, "term", "doc_freq")
    joined = salted_join(postings, freq, "term", heavy).crossJoin(F.broadcast(total_docs.select("n")))
    return joined.withColumn("weight", tf_weight(F.col("tf")) * idf(F.col("doc_freq"), F.col("n"))).drop("n")


def norms_snapshot(postings: DataFrame, total_docs: DataFrame) -> DataFrame:
    """(page_id, norm) under the final statistics: what a rebuild gives."""
    w = weighted_postings(postings, total_docs)
    return w.groupBy("page_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def norms_incremental(postings: DataFrame, sequence: DataFrame) -> DataFrame:
    """(page_id, norm) as a first build page by page leaves them: each under the statistics of its moment.

    `sequence` is (page_id, seq), seq counting documents from 1 in the order of indexing. The n of the k-th document is
    k - 1, at least 1; its document frequencies include itself. Running ranks per term are sequential; a term's
    occurrences are ranked over ranges of seq, so that no range is unbounded for one task.
    """
    span = 100_000
    rows = settle(postings.join(sequence, "page_id").withColumn("_range", F.floor(F.col("seq") / span)))
    sums = rows.groupBy("term", "_range").agg(F.count("*").alias("_rows"))
    before = sums.withColumn(
        "_before", F.coalesce(F.sum("_rows").over(Window.partitionBy("term").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("term", "_range").orderBy("seq")))
    w = ranked.join(before.drop("_rows"), ["term", "_range"]).select(
        "page_id",
        (tf_weight(F.col("tf")) * idf(F.col("_before") + F.col("_rank"), F.greatest(F.col("seq") - 1, F.lit(1)))).alias("w"),
    )
    return w.groupBy("page_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def reindexed(postings: DataFrame, fresh: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, deltas) after the pages in `changed` (page_id) got the postings `fresh`, those of other pages kept.

    deltas is (term, lost, won): how many of the changed pages have a term no more (negative), and how many have it
    newly; terms that a page keeps don't count. `postings` is read twice and should be a stored table.
    """
    fresh = settle(fresh)
    once = changed.select("page_id").distinct()
    old = postings.join(once, "page_id", "left_semi")
    pairs = ["term", "page_id"]
    lost = old.join(fresh, pairs, "left_anti").groupBy("term").agg((-F.count("*")).alias("lost"), F.lit(0).cast("long").alias("won"))
    won = fresh.join(old, pairs, "left_anti").groupBy("term").agg(F.lit(0).cast("long").alias("lost"), F.count("*").alias("won"))
    deltas = lost.unionByName(won).groupBy("term").agg(F.sum("lost").alias("lost"), F.sum("won").alias("won"))
    kept = postings.join(once, "page_id", "left_anti")
    return kept.select("term", "page_id", "tf").unionByName(fresh.select("term", "page_id", "tf")), deltas


def reindex(postings: DataFrame, terms: DataFrame, fresh: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, terms) after a change as in `reindexed`.

    A page's old terms that it has no more lower doc_freq (never below 0), new ones raise it; terms it keeps don't
    touch it. Terms whose doc_freq falls to 0 stay, as unused. Changed pages without fresh postings lose theirs.
    """
    after, deltas = reindexed(postings, fresh, changed)
    none = F.lit(0)
    freq = terms.join(deltas, "term", "full_outer").select(
        "term", (F.greatest(F.coalesce("doc_freq", none) + F.coalesce("lost", none), none) + F.coalesce("won", none)).alias("doc_freq")
    )
    return after, freq


def pages_needing_index(pages: DataFrame, limit: int) -> DataFrame:
    """The next pages to index: crawled, with body and content hash, not indexed in this state; oldest first, nulls first."""
    due = pages.where(
        (F.col("status") == "crawled") & F.col("minio_key").isNotNull() & F.col("content_hash").isNotNull()
        & ~F.col("last_indexed_hash").eqNullSafe(F.col("content_hash"))
    )
    return due.orderBy(F.asc_nulls_first("last_crawled_at"), F.asc("id")).limit(limit)
