"""Problem 2: at most so many records per contributor, chosen by quality-weighted reservoir sampling.

Each record gets the key  score / e ** spread,  e being an exponential random number derived from its id; the cap-size
largest keys of a contributor stay. With spread 1 this is weighted sampling without replacement (exponential keys
scaled by the score); with spread 0 the randomness is gone and the best scores stay. TESTDATA.md fixes p2_found as the
exact best eight of each host, so it is the reservoir with spread 0; p2_sample draws with spread 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.registry import query
from corvane.operators.skew import heavy_keys, salted_join
from corvane.plans.registry import HOST, NUM_PAGES
from corvane.session import settle
from corvane.sources.tables import page_hosts, table

CAP = 8
GROUP_LIMIT = 1000  # greatest cap for which Spark cuts a window's groups in each task before the shuffle


def ranked_by_ranges(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """rows with _rank within their group, from 1, for groups of any size; the order must leave no ties.

    Rows are partitioned by ranges of (group, order), numbered within each range and group, and raised by what the
    group has in the ranges before: one row per group and range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settle(rows.repartitionByRange(parts, F.asc(group), *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(group, "_range").agg(F.count("*").alias("_size"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inner = placed.withColumn("_rank", F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order)))
    return inner.join(offsets, [group, "_range"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before", "_range")


def cap_per_contributor(
    records: DataFrame, contributor: str, record: str, score: str, cap: int | None = None, share: float | None = None,
    spread: float = 1.0, seed: int = 42,
) -> DataFrame:
    """(contributor, record, score, kept) of every record; `record` must be unique.

    Give a cap or a share of all records (at least one record each). Scores that are null, NaN or negative count as
    0; equal keys keep the smaller record id. Records without a contributor are all kept. An empty table gives no
    rows; other columns are ignored. The record that holds the last place of each contributor is found, and joined back
    with heavy contributors salted. Up to GROUP_LIMIT only cap rows per contributor and task are sorted and sent (the
    window's group limit); beyond it the rows are ranked over ranges, so that no contributor lies in one task.
    """
    if (cap is None) == (share is None):
        raise ValueError("give either a cap or a share")
    weight = F.when((F.col(score) > 0) & ~F.isnan(score), F.col(score).cast("double")).otherwise(F.lit(0.0))
    unit = (F.pmod(F.xxhash64(F.col(record), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    key = weight / F.pow(-F.log(unit), F.lit(spread)) if spread else weight
    rows = settle(
        records.select(F.col(contributor).alias("_who"), F.col(record).alias("_id"), F.col(score).alias("_score"), key.alias("_key"))
    )
    if cap is None:
        cap = max(1, int(rows.count() * share))
    named = rows.where(F.col("_who").isNotNull())
    if cap <= GROUP_LIMIT:
        best = Window.partitionBy("_who").orderBy(F.desc("_key"), F.asc("_id"))
        ranked = named.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= cap)
    else:
        ranked = ranked_by_ranges(named, "_who", F.desc("_key"), F.asc("_id"))
    limits = ranked.where(F.col("_rank") == cap).select("_who", F.col("_key").alias("_least"), F.col("_id").alias("_last"))
    heavy = heavy_keys(named.groupBy("_who").agg(F.count("*").alias("_n")), "_who", "_n")
    kept = (
        F.col("_least").isNull()
        | (F.col("_key") > F.col("_least"))
        | ((F.col("_key") == F.col("_least")) & (F.col("_id") <= F.col("_last")))
    )
    return salted_join(rows, limits, "_who", heavy, "left").select(
        F.col("_who").alias(contributor), F.col("_id").alias(record), F.col("_score").alias(score), kept.alias("kept")
    )


@query(
    "p2_found",
    f"""WITH {NUM_PAGES}, r AS (SELECT id, row_number() OVER (PARTITION BY {HOST.format("url")}
    ORDER BY CASE WHEN isnan(pagerank) THEN 0 ELSE coalesce(pagerank, 0) END DESC, id) AS k FROM cur)
    SELECT id AS page_id FROM r WHERE k > {CAP}""",
)
def found(spark, where):
    ranked = cap_per_contributor(page_hosts(table(spark, where, "pages")), "host", "id", "pagerank", cap=CAP, spread=0.0)
    return ranked.where(~F.col("kept")).select(F.col("id").alias("page_id"))


@query("p2_sample")
def sample(spark, where):
    """The weighted sample: which pages stay and which fall out, per host."""
    drawn = cap_per_contributor(page_hosts(table(spark, where, "pages")), "host", "id", "pagerank", cap=CAP)
    return drawn.select("host", F.col("id").alias("page_id"), "kept")


@query(
    "p2_sample_sizes",
    f"""WITH {NUM_PAGES} SELECT {HOST.format("url")} AS host, count(*) AS pages, least({CAP}, count(*)) AS kept, true AS weighted FROM cur GROUP BY 1""",
)
def sample_sizes(spark, where):
    """Of each host the pages, and how many the weighted sample keeps; weighted: no page without score stays where one with a score falls out."""
    drawn = cap_per_contributor(page_hosts(table(spark, where, "pages")), "host", "id", "pagerank", cap=CAP)
    scored = F.col("pagerank") > 0
    sizes = drawn.groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if("kept").alias("kept"),
        F.count_if(~scored & F.col("kept")).alias("poor"), F.count_if(scored & ~F.col("kept")).alias("rich"),
    )
    return sizes.select("host", "pages", "kept", ((F.col("poor") == 0) | (F.col("rich") == 0)).alias("weighted"))
