"""Sources and sinks beside the tables: blob folders, fetch results, seeds, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.schemas import FETCH_RESULT

# The addresses a crawl starts from.
SEED_URLS = [
    "https://en.wikipedia.org/wiki/Web_crawler",
    "https://en.wikipedia.org/wiki/Search_engine",
    "https://en.wikipedia.org/wiki/Information_retrieval",
    "https://en.wikipedia.org/wiki/PageRank",
    "https://en.wikipedia.org/wiki/Inverted_index",
    "https://en.wikipedia.org/wiki/Tf%E2%80%93idf",
    "https://en.wikipedia.org/wiki/Robots_exclusion_standard",
    "https://en.wikipedia.org/wiki/Bloom_filter",
]


def seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u,) for u in SEED_URLS], "url string")


def read_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """(minio_key, html) of a folder of html files: bytes as UTF-8, bad ones replaced; the key is the path below folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").load(folder)
    key = F.regexp_extract("path", r"([^/]+/[^/]+\.html)$", 1)
    return files.select(key.alias("minio_key"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def put_bodies(old: DataFrame, new: DataFrame) -> DataFrame:
    """The blob table (minio_key, html) after writing `new`, one row per key: overwritten by key."""
    return old.join(new.select("minio_key"), "minio_key", "left_anti").unionByName(new)


def read_fetch_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of fetches from JSON lines. Spark jobs don't open connections; a fetcher writes these files."""
    return spark.read.schema(FETCH_RESULT).json(path)


def shape_fetch_result(rows: DataFrame, max_bytes: int = 5 * 1024 * 1024) -> DataFrame:
    """(status, url, body BINARY, content_type, charset) to fetch results: 304 isn't a body, a 200 that isn't html is an
    error, longer bodies are cut and then read as UTF-8."""
    from corvane.operators.crawl import decoded, is_html

    length = F.length("body")
    text = decoded(F.substring("body", 1, max_bytes), F.col("charset"), length > max_bytes)
    html = (F.col("status") == 200) & is_html(F.col("content_type"))
    error = F.when((F.col("status") == 200) & ~is_html(F.col("content_type")), F.lit("not html")).when(F.coalesce(F.col("status"), F.lit(0)) == 0, F.lit("no response"))
    return rows.select(
        "url", F.coalesce("status", F.lit(0)).alias("status"), F.when(html, text).alias("html"), F.least(length, F.lit(max_bytes)).alias("content_length"),
        (F.coalesce(F.col("status"), F.lit(0)) == 304).alias("not_modified"), error.alias("error"),
    )


def write_snapshot(df: DataFrame, path: str, by: str, buckets: int = 0) -> None:
    """Writes a table sorted by a column within its files, so that filters on it skip row groups."""
    placed = df.repartition(buckets, by) if buckets else df.repartition(by)
    placed.sortWithinPartitions(by).write.mode("overwrite").parquet(path)
