"""Link graph: resolution of links, edges between known pages, PageRank, bounded expansion from seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.skew import heavy_keys, salted_join
from corvane.session import settle

IN_GRAPH = ("crawled", "not_modified")


def resolve_links(links: DataFrame, pages: DataFrame, late: bool = True) -> DataFrame:
    """links with dst_page_id looked up by url: for all (late), or as stored where it is null now (late=False keeps them).

    Links once each by (src_page_id, dst_url). A heavily linked url is salted.
    """
    once = links.dropDuplicates(["src_page_id", "dst_url"])
    if not late:
        return once
    once = settle(once)  # read for the heavy targets and for the join
    known = pages.select(F.col("url").alias("dst_url"), F.col("id").alias("_dst")).groupBy("dst_url").agg(F.min("_dst").alias("_dst"))
    heavy = heavy_keys(once.groupBy("dst_url").agg(F.count("*").alias("n")), "dst_url", "n")
    joined = salted_join(once, known, "dst_url", heavy, "left")
    return joined.withColumn("dst_page_id", F.coalesce("_dst", "dst_page_id")).drop("_dst")


def graph_nodes(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("status").isin(*IN_GRAPH)).select("id").distinct()


def graph_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst) of links whose ends are both nodes; parallel ones and loops stay. Heavy ends are salted."""
    edges = links.where(F.col("dst_page_id").isNotNull()).select(F.col("src_page_id").alias("src"), F.col("dst_page_id").alias("dst"))
    edges, ids = settle(edges), settle(nodes.select("id").distinct())  # two numbers a row and one, each read several times
    heavy = {end: heavy_keys(edges.groupBy(end).agg(F.count("*").alias("n")), end, "n") for end in ("src", "dst")}
    for end in ("src", "dst"):
        edges = salted_join(edges, ids.withColumnRenamed("id", end), end, heavy[end])
    return edges.select("src", "dst")


def rank_round(light: DataFrame, heavy: DataFrame | None, ranks: DataFrame, n: int, damping: float) -> DataFrame:
    """(id, ends, rank) after one round. Edges and ranks lie partitioned alike; only sums by target are shuffled."""
    offered = ranks.where(~F.col("ends")).select(F.col("id").alias("src"), "rank")
    given = light.join(offered.hint("shuffle_hash"), "src").select("dst", (F.col("rank") * F.col("share")).alias("give"))
    if heavy is not None:
        few = offered.join(F.broadcast(heavy.select("src").distinct()), "src", "left_semi")  # a hundred rows at most
        given = given.unionByName(heavy.join(F.broadcast(few), "src").select("dst", (F.col("rank") * F.col("share")).alias("give")))
    lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("ends"), F.col("rank"))), F.lit(0.0)).alias("lost"))
    got = given.groupBy(F.col("dst").alias("id")).agg(F.sum("give").alias("got"))
    step = ranks.select("id", "ends").join(got.hint("shuffle_hash"), "id", "left").crossJoin(F.broadcast(lost))
    value = (1 - damping) / n + damping * F.col("lost") / n + damping * F.coalesce("got", F.lit(0.0))
    return step.select("id", "ends", value.alias("rank"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """(id, rank) after a fixed number of rounds, summing up to 1; nodes without outlinks give to all alike.

    Edges carry their share 1/outdegree and are written once, partitioned by source as the ranks are by id, so that a
    round joins the two where they lie. Sources that hold a hundredth of all edges, a hundred at most, have theirs
    spread by target and get their ranks broadcast. What is shuffled in a round are the sums by target, combined before.
    Ranks are written after each round: lineage stays short and a lost executor costs little. An empty graph gives no
    rows.
    """
    nodes = settle(nodes.select("id"))
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = settle(edges.groupBy("src", "dst").agg(F.count("*").alias("times")))
    degree = settle(pairs.groupBy("src").agg(F.sum("times").alias("deg")).repartition(parts, "src"), keep_partitioning=True)
    many = settle(heavy_keys(degree, "src", "deg"))
    mark = F.broadcast(many.withColumn("_heavy", F.lit(True)))
    marked = pairs.join(mark, "src", "left")
    share = (F.col("times") / F.col("deg")).alias("share")
    rest = marked.where(F.col("_heavy").isNull()).select("src", "dst", "times").repartition(parts, "src")
    light = settle(rest.join(degree.hint("shuffle_hash"), "src").select("src", "dst", share), keep_partitioning=True)
    heavy = None
    if many.count():
        few = degree.join(F.broadcast(many), "src", "left_semi")
        heavy = settle(marked.where("_heavy").select("src", "dst", "times").join(F.broadcast(few), "src").select("src", "dst", share).repartition(parts, "dst"))
    ends = nodes.repartition(parts, "id").join(degree.withColumnRenamed("src", "id").hint("shuffle_hash"), "id", "left").select("id", F.col("deg").isNull().alias("ends"))
    ranks = settle(ends.withColumn("rank", F.lit(1.0 / n)), keep_partitioning=True)
    for _ in range(iterations):
        ranks = settle(rank_round(light, heavy, ranks, n, damping), keep_partitioning=True)
    return ranks.select("id", "rank")


def write_ranks(pages: DataFrame, ranks: DataFrame) -> DataFrame:
    """pages with new ranks; pages outside the graph keep theirs."""
    joined = pages.join(ranks.select("id", F.col("rank").alias("_new")), "id", "left")
    return joined.withColumn("pagerank", F.coalesce("_new", "pagerank")).drop("_new")


def expand(seeds: DataFrame, edges: DataFrame, max_depth: int, allowed: Column | None = None) -> DataFrame:
    """(id, depth): nodes within max_depth steps of the seeds with their least depth; `allowed` filters edges.

    One join per level, edges of heavy sources salted; the seen set leaves the frontier by an anti-join. Levels are
    written, not recomputed.
    """
    steps = settle((edges.where(allowed) if allowed is not None else edges).select("src", "dst"))
    heavy = settle(heavy_keys(steps.groupBy("src").agg(F.count("*").alias("n")), "src", "n"))
    seen = settle(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    levels = [seen]
    for depth in range(1, max_depth + 1):
        reached = salted_join(steps, levels[-1].select(F.col("id").alias("src")), "src", heavy).select(F.col("dst").alias("id")).distinct()
        known = reduce(DataFrame.unionByName, levels)
        levels.append(settle(reached.join(known.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth))))
    return reduce(DataFrame.unionByName, levels)
