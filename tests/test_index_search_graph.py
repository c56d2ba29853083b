import json
import math

import pytest
from pyspark.sql import functions as F

from corvane.operators import graph, index, search
from corvane.operators.index import document_frequencies
from corvane.session import settle

DOCS = [(1, "alpha beta beta"), (2, "beta gamma"), (3, ""), (4, None), (5, "alpha alpha gamma delta")]


@pytest.fixture(scope="module")
def postings(spark):
    return index.build_postings(spark.createDataFrame(DOCS, "page_id bigint, text string"), "page_id", "text").cache()


def n_of(spark, n):
    return spark.createDataFrame([(n,)], "n bigint")


def test_norms(spark, postings):
    got = {r.page_id: r.norm for r in index.norms_snapshot(postings, n_of(spark, 5)).collect()}
    w = lambda tf, df, n: (1 + math.log(tf)) * (math.log((1 + n) / (1 + df)) + 1)
    assert got[1] == pytest.approx(math.hypot(w(1, 2, 5), w(2, 2, 5))) and set(got) == {1, 2, 5}
    seq = spark.createDataFrame([(1, 1), (2, 2), (5, 3)], "page_id bigint, seq bigint")
    inc = {r.page_id: r.norm for r in index.norms_incremental(postings, seq).collect()}
    assert inc[1] == pytest.approx(math.hypot(w(1, 1, 1), w(2, 1, 1))) and inc[2] == pytest.approx(math.hypot(w(1, 2, 1), w(1, 1, 1)))


def test_first_document_norm(spark):
    one = index.build_postings(spark.createDataFrame([(1, "solo")], "page_id bigint, text string"), "page_id", "text")
    seq = spark.createDataFrame([(1, 1)], "page_id bigint, seq bigint")
    assert index.norms_incremental(one, seq).first().norm == 1.0


def test_reindex_equals_rebuild(spark, postings):
    changed = spark.createDataFrame([(1, "beta epsilon"), (5, None)], "page_id bigint, text string")
    fresh = index.build_postings(changed, "page_id", "text")
    new, terms = index.reindex(postings, document_frequencies(postings), fresh, changed)
    whole = index.build_postings(spark.createDataFrame([(1, "beta epsilon"), (2, "beta gamma"), (5, None)], "page_id bigint, text string"), "page_id", "text")
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, whole.collect()))
    assert {r.term: r.doc_freq for r in terms.collect()} == {"alpha": 0, "beta": 2, "gamma": 1, "delta": 0, "epsilon": 1}


def test_pages_needing_index(spark):
    rows = [(1, "crawled", "k", "h", None, "2025-01-02"), (2, "crawled", "k", "h", "h", None), (3, "crawled", "k", "h", "g", None), (4, "not_modified", "k", "h", None, None), (5, "crawled", None, "h", None, None)]
    p = spark.createDataFrame(rows, "id bigint, status string, minio_key string, content_hash string, last_indexed_hash string, last_crawled_at string")
    assert [r.id for r in index.pages_needing_index(p, 10).collect()] == [3, 1]


def pages(spark):
    rows = [(1, "https://a/1", "One", "a", 1.0, 0.0, "k1"), (2, "https://a/2", "Two", "a", 1.0, 0.9, "k2"), (5, "https://b/5", None, "b", None, float("nan"), None)]
    return spark.createDataFrame(rows, "id bigint, url string, title string, domain string, tfidf_norm double, pagerank double, minio_key string").withColumn("last_crawled_at", F.lit(None).cast("timestamp"))


def test_search(spark, postings):
    freq, n = document_frequencies(postings), n_of(spark, 1000)
    bodies = spark.createDataFrame([("k1", "<body>The alpha and the beta</body>")], "minio_key string, html string").withColumn("stored_at", F.lit(None).cast("timestamp"))
    hits = search.search(spark, "Betas alpha", postings, freq, pages(spark), pages(spark), bodies, n).orderBy(F.desc("score")).collect()
    assert [h.page_id for h in hits] == [5, 1, 2] or {h.page_id for h in hits} == {1, 2, 5}
    assert {h.page_id: h.snippet for h in hits}[1] == "The alpha and the beta" and {h.page_id: h.snippet for h in hits}[2] == ""
    assert search.search(spark, "the and", postings, freq, pages(spark), pages(spark), bodies, n).count() == 0
    top = search.rank(search.query_terms(spark, "beta"), postings, freq, pages(spark), n, 1, 2.0).collect()
    assert len(top) == 1
    plain = search.rank(search.query_terms(spark, "gamma"), postings, freq, pages(spark), n, 10, 0.0).collect()
    assert {r.page_id for r in plain} == {2, 5}
    body = search.as_response("q", search.search(spark, "beta", postings, freq, pages(spark), pages(spark), bodies, n), search.total_matches(search.query_terms(spark, "beta"), postings)).first().response
    assert json.loads(body)["total_matches"] == 2 and len(json.loads(body)["results"]) == 2
    shown = {r.id: (r.shown_title, r.shown_domain) for r in search.shown(pages(spark).withColumn("domain", F.when(F.col("id") > 1, F.col("domain")))).collect()}
    assert shown == {1: ("One", "a"), 2: ("Two", "a"), 5: ("https://b/5", "b")}


def test_postings_of_terms(spark):
    raw = spark.createDataFrame([(" Page", 1, 2), ("\uff30\uff21\uff27\uff25", 2, 1), ("other", 3, 1), ("page", None, 1), (None, 4, 1)], "term string, page_id bigint, tf int")
    assert sorted(map(tuple, search.postings_of_terms(raw, ["page"]).collect())) == [("page", 1, 2), ("page", 2, 1)]
    assert search.postings_of_terms(raw, []).count() == 0


def test_requests():
    assert search.check_request("x", None) == 10
    for bad in (("", 5), ("  ", 5), ("x", 0), ("x", 51), ("x" * 501, 5)):
        with pytest.raises(ValueError):
            search.check_request(*bad)


def test_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "key string, value double")
    row = search.stats(empty, spark.createDataFrame([], "last_crawled_at timestamp")).first()
    assert (row.total_docs, row.total_terms, row.last_crawl_at) == (0, 0, None)


def ranks(spark, edges, nodes, **more):
    e, v = spark.createDataFrame(edges, "src bigint, dst bigint"), spark.createDataFrame([(n,) for n in nodes], "id bigint")
    return {r.id: r["rank"] for r in graph.pagerank(v, e, **more).collect()}


def test_pagerank(spark):
    ring = ranks(spark, [(1, 2), (2, 3), (3, 1)], [1, 2, 3])
    assert all(v == pytest.approx(1 / 3) for v in ring.values())
    star = ranks(spark, [(2, 1), (3, 1), (4, 1)], [1, 2, 3, 4], iterations=10)
    assert sum(star.values()) == pytest.approx(1) and star[1] > star[2] == pytest.approx(star[3])
    lone = ranks(spark, [(1, 2), (2, 1)], [1, 2, 3], iterations=40)
    assert lone[3] == pytest.approx(0.05 / (1 - 0.85 / 3), rel=1e-6)
    assert ranks(spark, [], [7], iterations=2) == {7: pytest.approx(1.0)} and ranks(spark, [], []) == {}


def test_pagerank_of_a_hub_equals_brute_force(spark):
    """A third of the edges leave one page, so that they are spread and its rank is broadcast."""
    edges = [(0, i) for i in range(1, 60)] + [(i, (7 * i) % 60) for i in range(1, 60)] + [(i, i + 1) for i in range(1, 59)] + [(5, 6), (5, 6)]
    got = ranks(spark, edges, range(62), iterations=8)
    now, out = [1 / 62] * 62, {}
    for s, d in edges:
        out.setdefault(s, []).append(d)
    for _ in range(8):
        new = [0.15 / 62 + 0.85 * sum(r for k, r in enumerate(now) if k not in out) / 62] * 62
        for s, ds in out.items():
            for d in ds:
                new[d] += 0.85 * now[s] / len(ds)
        now = new
    assert all(got[k] == pytest.approx(v, rel=1e-9) for k, v in enumerate(now)) and sum(got.values()) == pytest.approx(1)


def test_a_round_moves_no_edges(spark):
    """Neither edges nor ranks are shuffled by a round: the only hash exchange is that of the sums by target."""
    light = settle(spark.range(200).select(F.col("id").alias("src"), (F.col("id") % 7).alias("dst"), F.lit(1.0).alias("share")).repartition(4, "src"), keep_partitioning=True)
    ranks_ = settle(spark.range(200).select("id", F.lit(False).alias("ends"), F.lit(0.005).alias("rank")).repartition(4, "id"), keep_partitioning=True)
    step = graph.rank_round(light, None, ranks_, 200, 0.85)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = step.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(dst" in plan, plan


def test_links_and_expansion(spark):
    p = spark.createDataFrame([(1, "u1", "crawled"), (2, "u2", "failed"), (3, "u3", "not_modified")], "id bigint, url string, status string")
    links = spark.createDataFrame([(1, "u3", None), (1, "u3", None), (1, "u2", None), (3, "u1", 1), (3, "zz", None)], "src_page_id bigint, dst_url string, dst_page_id bigint")
    solved = graph.resolve_links(links, p)
    assert sorted((r.src_page_id, r.dst_url, r.dst_page_id or 0) for r in solved.collect()) == [(1, "u2", 2), (1, "u3", 3), (3, "u1", 1), (3, "zz", 0)]
    assert graph.resolve_links(links, p, late=False).where("dst_page_id is null").count() == 3
    edges = graph.graph_edges(solved, graph.graph_nodes(p))
    assert sorted(map(tuple, edges.collect())) == [(1, 3), (3, 1)]
    path = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(0, 3)], "src bigint, dst bigint")
    got = {r.id: r.depth for r in graph.expand(spark.createDataFrame([(0,)], "id bigint"), path, 2).collect()}
    assert got == {0: 0, 1: 1, 3: 1, 2: 2, 4: 2}
