"""Queries on the link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import graph
from corvane.plans.registry import HOST, NUM_PAGES, query
from corvane.sources.tables import current_pages, table

LINKS = """once AS (SELECT src_page_id, dst_url, min(dst_page_id) AS dst_page_id FROM links GROUP BY 1, 2),
    res AS (SELECT src_page_id, dst_url, coalesce(k.id, dst_page_id) AS dst_page_id FROM once LEFT JOIN (SELECT url, min(id) AS id FROM cur GROUP BY 1) k ON k.url = dst_url)"""
EDGES = """nodes AS (SELECT id FROM cur WHERE status IN ('crawled', 'not_modified')),
    edges AS (SELECT src_page_id AS src, dst_page_id AS dst FROM res WHERE src_page_id IN (SELECT id FROM nodes) AND dst_page_id IN (SELECT id FROM nodes))"""


def rank_sql(rounds: int = 20) -> str:
    steps = [
        """deg AS MATERIALIZED (SELECT src, count(*) AS d FROM edges GROUP BY 1), n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM nodes),
        r0 AS MATERIALIZED (SELECT id, 1 / n AS rank FROM nodes, n)"""
    ]
    for k in range(rounds):
        steps.append(f"""r{k + 1} AS MATERIALIZED (SELECT id, 0.15 / n + 0.85 * coalesce((SELECT sum(rank) FROM r{k} WHERE id NOT IN (SELECT src FROM deg)), 0) / n
        + 0.85 * coalesce(got, 0) AS rank FROM nodes LEFT JOIN (SELECT dst, sum(rank / d) AS got FROM edges JOIN r{k} ON id = src JOIN deg USING (src) GROUP BY 1) g ON g.dst = id, n)""")
    return ", ".join(steps) + f", ranks AS (SELECT id, rank FROM r{rounds})"


def links_and_nodes(spark, where):
    pages = current_pages(table(spark, where, "pages"), "url", "status", "depth")
    links = graph.resolve_links(table(spark, where, "links").select("src_page_id", "dst_url", "dst_page_id"), pages.select("id", "url"))
    return links, graph.graph_nodes(pages), pages


@query("link_graph_resolve", f"WITH {NUM_PAGES}, {LINKS} SELECT src_page_id, dst_url, dst_page_id FROM res")
def link_graph_resolve(spark, where):
    return links_and_nodes(spark, where)[0]


@query("link_graph_edges", f"WITH {NUM_PAGES}, {LINKS}, {EDGES} SELECT src, dst FROM edges")
def link_graph_edges(spark, where):
    links, nodes, _ = links_and_nodes(spark, where)
    return graph.graph_edges(links, nodes)


@query("out_degree", f"WITH {NUM_PAGES}, {LINKS}, {EDGES} SELECT src, count(*) AS degree FROM edges GROUP BY 1")
def out_degree(spark, where):
    links, nodes, _ = links_and_nodes(spark, where)
    return graph.graph_edges(links, nodes).groupBy("src").agg(F.count("*").alias("degree"))


@query("pagerank", f"WITH {NUM_PAGES}, {LINKS}, {EDGES}, {rank_sql()} SELECT id, round(rank, 10) AS rank FROM ranks")
def pagerank(spark, where):
    links, nodes, _ = links_and_nodes(spark, where)
    return graph.pagerank(nodes, graph.graph_edges(links, nodes)).select("id", F.round("rank", 10).alias("rank"))


@query(
    "pagerank_write",
    f"WITH {NUM_PAGES}, {LINKS}, {EDGES}, {rank_sql()} SELECT id, round(coalesce(rank, CASE WHEN isnan(pagerank) THEN NULL ELSE pagerank END), 10) AS pagerank FROM cur LEFT JOIN ranks USING (id)",
)
def pagerank_write(spark, where):
    links, nodes, _ = links_and_nodes(spark, where)
    ranks = graph.pagerank(nodes, graph.graph_edges(links, nodes))
    pages = current_pages(table(spark, where, "pages"), "pagerank").withColumn("pagerank", F.nanvl("pagerank", F.lit(None).cast("double")))
    return graph.write_ranks(pages, ranks).select("id", F.round("pagerank", 10).alias("pagerank"))


@query(
    "bfs_expand",
    f"""WITH RECURSIVE {NUM_PAGES}, {LINKS}, e AS (SELECT DISTINCT src_page_id AS src, dst_page_id AS dst FROM res JOIN cur a ON a.id = src_page_id JOIN cur b ON b.id = dst_page_id
        WHERE {HOST.format("a.url")} = {HOST.format("b.url")}),
    walk(id, depth) AS (SELECT id, 0 FROM cur WHERE depth = 0 UNION SELECT e.dst, walk.depth + 1 FROM walk JOIN e ON e.src = walk.id WHERE walk.depth < 2)
    SELECT id, min(depth) AS depth FROM walk GROUP BY 1""",
)
def bfs_expand(spark, where):
    """From the pages of depth 0, two steps along links that stay on their host."""
    from corvane.functions.urls import host_of

    links, _, pages = links_and_nodes(spark, where)
    hosts = pages.select("id", host_of("url").alias("host"))
    ends = links.join(hosts.select(F.col("id").alias("src_page_id"), F.col("host").alias("h1")), "src_page_id").join(
        hosts.select(F.col("id").alias("dst_page_id"), F.col("host").alias("h2")), "dst_page_id"
    )
    edges = ends.select(F.col("src_page_id").alias("src"), F.col("dst_page_id").alias("dst"), "h1", "h2")
    return graph.expand(pages.where(F.col("depth") == 0), edges, 2, F.col("h1") == F.col("h2"))
