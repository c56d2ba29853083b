"""Scans of the tables and the views that clean them: current page states, current bodies, valid postings.

All views read only the columns they are asked for, so that pruning reaches the Parquet scan.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import fold_term
from corvane.functions.urls import host_of
from corvane.operators.skew import heavy_keys, salted_join
from corvane.schemas import TABLES, table_schema
from corvane.session import settle


def table(spark: SparkSession, where: str, name: str) -> DataFrame:
    """Scans where/name.parquet; known tables are read with their declared schema."""
    reader = spark.read.schema(table_schema(name)) if name in TABLES else spark.read
    return reader.parquet(f"{where}/{name}.parquet")


def latest(df: DataFrame, key: str, by: str, *columns: str) -> DataFrame:
    """One row per key: the one with the greatest `by` (null is least); equal ones are decided by the other columns.

    Reduced in each task before the shuffle, so that a key's copies never meet unreduced. For narrow columns: rows with
    strings are sorted for it. Rows whose key is null are dropped. An empty input gives no rows.
    """
    rest = [c for c in dict.fromkeys(columns) if c not in (key, by)]
    order = F.struct(F.col(by).isNotNull().alias("_has"), F.col(by).alias(by), *[F.col(c) for c in rest])
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in dict.fromkeys(columns) if c != key])


def current_pages(pages: DataFrame, *columns: str) -> DataFrame:
    """Page states by id; of several rows of an id the latest last_crawled_at counts."""
    columns = columns or tuple(c for c in pages.columns)
    return latest(pages, "id", "last_crawled_at", *columns)


def located(df: DataFrame) -> DataFrame:
    """df with _at, which tells its rows apart: file and row number of a scan; other inputs are written and numbered."""
    try:
        return df.withColumn("_at", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    except AnalysisException:
        return settle(df.withColumn("_at", F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))))


def last_stored(places: DataFrame) -> DataFrame:
    """(minio_key, _at): the place of the body stored last under each key, of equal times that with the greatest hash."""
    order = F.struct(F.col("stored_at").isNotNull().alias("has"), "stored_at", F.xxhash64("html").alias("hash"), "_at")
    best = places.where(F.col("minio_key").isNotNull()).groupBy("minio_key").agg(F.max(order).alias("_best"))
    return best.select("minio_key", F.col("_best._at").alias("_at"))


def bodies_at(wanted: DataFrame, places: DataFrame) -> DataFrame:
    """wanted (with _at) joined with the body at each place.

    What is wanted is found on narrow rows; bodies are shuffled once, by place, so that no key's copies meet, and
    neither sorted nor aggregated. A body that many pages share is copied for them, salted.
    """
    wanted = settle(wanted)
    heavy = heavy_keys(wanted.groupBy("_at").agg(F.count("*").alias("_n")), "_at", "_n")
    return salted_join(wanted, places.select("_at", "html"), "_at", heavy, narrow_facts=True).drop("_at")


def current_bodies(html_objects: DataFrame) -> DataFrame:
    """(minio_key, html): the body stored last under each key; copies count once."""
    places = located(html_objects)
    return bodies_at(last_stored(places), places).select("minio_key", "html")


def bodies_of_pages(pages: DataFrame, html_objects: DataFrame, *columns: str) -> DataFrame:
    """(id, html, columns...) for each page whose minio_key has a stored body."""
    places = located(html_objects)
    held = current_pages(pages, "minio_key", *columns).where(F.col("minio_key").isNotNull())
    wanted = held.join(last_stored(places), "minio_key")
    return bodies_at(wanted, places).select("id", "html", *[c for c in columns if c != "minio_key"])


def clean_postings(postings: DataFrame) -> DataFrame:
    """(term, page_id, tf): terms folded, rows without a positive tf dropped, repeated rows counted once.

    Where copies of a (term, page_id) disagree, the greatest tf counts. Null terms and page ids are no postings.
    """
    valid = postings.where((F.col("tf") >= 1) & F.col("page_id").isNotNull() & F.col("term").isNotNull())
    folded = fold_term(valid.select("term", "page_id", "tf"), "term")
    return folded.where(F.col("term") != "").groupBy("term", "page_id").agg(F.max("tf").alias("tf"))


def page_hosts(pages: DataFrame) -> DataFrame:
    """(id, host, pagerank) of the current state; the host is that of the url, pagerank null or NaN counts as 0."""
    score = F.when(F.isnan("pagerank") | F.col("pagerank").isNull(), F.lit(0.0)).otherwise(F.col("pagerank"))
    return current_pages(pages, "url", "pagerank").select("id", host_of("url").alias("host"), score.alias("pagerank"))

