import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvane.config import CrawlOptions
from corvane.operators import crawl, monitor

def now():
    return F.lit("2025-01-01 00:00:00").cast("timestamp")


def test_retry_policy(spark):
    def out(n, **o):
        r = spark.range(1).select(crawl.retry_outcome(F.lit(n), CrawlOptions(**o)).alias("r")).first().r
        return r.outcome, r.delay

    assert [out(n, max_retries=9)[1] for n in (1, 2, 3, 4)] == [5, 10, 20, 40]
    assert out(6, max_retries=9, retry_cap_sec=60.0) == ("retry_scheduled", 60)
    assert out(4, max_retries=3) == ("failed", None) and out(1, max_retries=0) == ("failed", None)


def test_delays(spark):
    r = spark.range(1).select(
        *[crawl.crawl_delay(F.lit(d).cast("double")).alias(f"d{i}") for i, d in enumerate((None, 1.0, 10.0))],
        crawl.limiter_ttl_ms(F.lit(0.0001)).alias("t"), crawl.seconds_until_free(F.lit(-2)).alias("s"), crawl.seconds_until_free(F.lit(1500)).alias("u"),
    ).first()
    assert (r.d0, r.d1, r.d2, r.t, r.s, r.u) == (3, 3, 10, 1, 0, 1.5)


def test_rate_limit(spark):
    rows = [("d", f"e{t}", t) for t in (0, 1000, 3500, 5000, 7000)] + [("x", "x0", 10), (None, "n", 1)]
    df = spark.createDataFrame(rows, "domain string, entry_id string, ms bigint").withColumn("wait", F.lit(3000).cast("long"))
    got = crawl.accept_by_rate(df, "domain", "ms", "wait", "entry_id").where("accepted").orderBy("ms").collect()
    assert [r.ms for r in got] == [0, 10, 3500, 7000]
    assert crawl.accept_by_rate(df.limit(0), "domain", "ms", "wait", "entry_id").count() == 0


def page_frame(spark, rows):
    ddl = """id bigint, url string, status string, http_status int, title string, content_hash string, etag string, last_modified string, content_length int,
    minio_key string, first_crawled_at timestamp, last_crawled_at timestamp, next_crawl_at timestamp, error string, retry_count int, next_retry_at timestamp"""
    return spark.createDataFrame([r + (None,) * (16 - len(r)) for r in rows], ddl)


def test_apply_results(spark):
    p = page_frame(spark, [(i, f"u{i}", "pending") for i in range(1, 8)]).withColumn("retry_count", F.when(F.col("id") == 3, 3))
    results = spark.createDataFrame(
        [(1, "success"), (2, "failure"), (3, "failure"), (4, "permanent"), (5, "skipped"), (6, "not_modified")], "id bigint, kind string"
    ).select("id", "kind", F.lit(200).alias("http_status"), *[F.lit("v").alias(c) for c in ("title", "content_hash", "etag", "last_modified", "minio_key")], F.lit(9).alias("content_length"), F.repeat(F.lit("e"), F.lit(3000)).alias("error"))
    got = {r.id: r for r in crawl.apply_results(p, results, now()).collect()}
    assert [got[i].status for i in range(1, 8)] == ["crawled", "pending", "failed", "failed", "skipped", "not_modified", "pending"]
    assert got[1].first_crawled_at and got[1].title == "v" and got[1].next_crawl_at - got[1].last_crawled_at == dt.timedelta(hours=24)
    assert got[2].retry_count == 1 and got[2].next_retry_at - dt.datetime(2025, 1, 1) == dt.timedelta(seconds=5) and len(got[2].error) == 2000
    assert got[3].next_retry_at is None and got[5].last_crawled_at is None and got[6].title is None and got[7].http_status is None


def test_results_with_texts_made_after_a_shuffle_are_not_broadcast(spark):
    p = page_frame(spark, [(i, f"u{i}", "pending") for i in range(1, 8)])
    results = p.groupBy("id").agg(F.max("status").alias("status")).select(
        "id", F.lit("failure").alias("kind"), F.lit(500).alias("http_status"), *[F.lit("v").alias(c) for c in ("title", "content_hash", "etag", "last_modified", "minio_key")],
        F.lit(9).alias("content_length"), F.repeat(F.lit("e"), F.lit(3000)).alias("error"),
    )
    after = crawl.apply_results(p, results, now())
    assert sorted((r.id, r.status, r.retry_count, len(r.error)) for r in after.collect()) == [(i, "pending", 1, 2000) for i in range(1, 8)]
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert "Final Plan" in plan and "Broadcast" not in plan.split("Initial Plan")[0]


def test_claims(spark):
    p = page_frame(spark, [(1, "a", "crawled"), (2, "b", "crawled"), (3, "c", "pending")])
    p = p.withColumn("next_crawl_at", F.when(F.col("id") == 1, now())).withColumn("next_retry_at", F.when(F.col("id") == 3, now()))
    assert [r.id for r in crawl.due_for_recrawl(p, now()).collect()] == [1] and [r.id for r in crawl.due_for_retry(p, now()).collect()] == [3]
    after = crawl.claim(p, crawl.due_for_recrawl(p, now()), "next_crawl_at")
    assert crawl.due_for_recrawl(after, now()).count() == 0
    assert crawl.mark_in_progress(p, p.where("id = 2")).where("status = 'in_progress'").count() == 1


def test_frontier(spark):
    rows = [("100-2", "HTTP://A/x", "a", "1", "7"), ("100-10", "http://a/x#y", "", "", ""), ("99-5", None, None, None, None), ("99-5", None, None, None, None), ("7-0", "mailto:x", "a", "q", "z")]
    items = crawl.frontier_items(spark.createDataFrame(rows, "entry_id string, url string, domain string, depth string, parent_id string"))
    got = {r.entry_id: r for r in items.collect()}
    assert len(got) == 4 and got["100-2"].url == "http://a/x" and got["100-10"].depth == 0 and got["100-10"].parent_id is None and got["7-0"].url is None
    pages = spark.createDataFrame([("http://b/",)], "url string")
    assert [(r.url, r.entry_id) for r in crawl.unseen(items, pages).collect()] == [("http://a/x", "100-2")]
    given = spark.createDataFrame([("100-2", 0, False), ("7-0", 0, True)], "entry_id string, claimed_ms bigint, acked boolean")
    claimed = lambda now: [r.entry_id for r in crawl.claim_entries(items.select("entry_id", "ms", "seq"), given, now, 1000, 5).collect()]
    assert claimed(2000) == ["100-2"] and claimed(500) == ["99-5", "100-10"]


def test_upserts(spark):
    d = spark.createDataFrame([("a", "r", None, 5.0, True)], "domain string, robots_txt string, robots_fetched_at timestamp, crawl_delay_sec double, disallow_all boolean")
    hosts = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "domain string")
    got = {r.domain: r for r in crawl.ensure_domains(d, hosts).collect()}
    assert set(got) == {"a", "b"} and got["a"].crawl_delay_sec == 5 and got["b"].crawl_delay_sec == 3 and got["b"].disallow_all is False
    new = spark.createDataFrame([("a", None, None, 3.0, False), ("c", "x", None, 4.0, False)], d.schema)
    got = {r.domain: r for r in crawl.update_robots(d, new).collect()}
    assert got["a"].robots_txt is None and got["c"].crawl_delay_sec == 4
    pages = spark.createDataFrame([(10, "u1"), (11, "u2")], "id bigint, url string")
    found = spark.createDataFrame([("u2", 5), ("z", 9), ("y", 3), ("z", 1), (None, 2)], "url string, seq bigint")
    assert sorted((r.url, r.id, r.created) for r in crawl.get_or_create_pages(pages, found).collect()) == [("u2", 11, False), ("y", 13, True), ("z", 12, True)]
    links = spark.createDataFrame([(1, "u1")], "src_page_id bigint, dst_url string")
    more = spark.createDataFrame([(1, "u1", "old", 0), (1, "u2", "first", 1), (1, "u2", "second", 2), (1, "q", "", 3)], "src_page_id bigint, dst_url string, anchor_text string, pos int")
    assert sorted((r.dst_url, r.dst_page_id, r.anchor_text) for r in crawl.insert_links(links, pages, more).collect()) == [("q", None, ""), ("u2", 11, "first")]


def test_robots(spark):
    fetched = spark.createDataFrame([("a", 200, "User-agent: *\nDisallow: /no"), ("b", 403, None), ("c", 404, "x")], "domain string, status int, body string")
    rules = crawl.robots_rules(fetched, now())
    urls = spark.createDataFrame([("http://a/no/1",), ("http://a/yes",), ("http://b/",), ("http://c/no",), ("http://d/",), ("bad",)], "url string")
    got = {r.url: r.allowed for r in crawl.robots_allow(urls, rules).collect()}
    assert got == {"http://a/no/1": False, "http://a/yes": True, "http://b/": False, "http://c/no": True, "http://d/": True}
    resolved = spark.createDataFrame([("h", "10.0.0.1"), ("h", "8.8.8.8"), ("g", "127.0.0.1")], "host string, ip string")
    assert {r.host: (r.addresses, r.reachable) for r in crawl.safe_addresses(resolved).collect()} == {"h": (["8.8.8.8"], True), "g": ([], False)}


def test_robots_delay_and_fetch_time(spark):
    texts = [("a", 200, "User-agent: *\nCrawl-delay: 7\nDisallow: /x"), ("b", 200, "User-agent: *\nCrawl-delay: 1"), ("c", 200, "User-agent: other\nCrawl-delay: 9"), ("d", 401, None), ("e", None, None), ("f", 200, "")]
    got = {r.domain: r for r in crawl.robots_rules(spark.createDataFrame(texts, "domain string, status int, body string"), now()).collect()}
    assert {d: r.crawl_delay_sec for d, r in got.items()} == {"a": 7, "b": 3, "c": 3, "d": 3, "e": 3, "f": 3}
    assert got["d"].disallow_all and not got["e"].disallow_all and got["e"].robots_txt is None and got["a"].robots_fetched_at == dt.datetime(2025, 1, 1)
    known = spark.createDataFrame([("a", None, None, 3.0, False), ("z", "t", None, 5.0, True)], "domain string, robots_txt string, robots_fetched_at timestamp, crawl_delay_sec double, disallow_all boolean")
    after = {r.domain: r for r in crawl.update_robots(known, crawl.robots_rules(spark.createDataFrame(texts, "domain string, status int, body string"), now())).collect()}
    assert after["a"].crawl_delay_sec == 7 and after["a"].robots_fetched_at and after["z"].crawl_delay_sec == 5 and len(after) == 7


def test_page_cap(spark):
    pages = spark.createDataFrame([(1, "http://a/", 0, "crawled"), (2, "http://a/2", 1, "not_modified")], "id bigint, url string, depth int, status string")
    items = spark.createDataFrame([("e", "http://a/3", 1)], "entry_id string, url string, parent_id bigint")
    fetched = crawl.fetched_page_count(pages)
    assert crawl.expandable(items, pages, CrawlOptions(max_pages=3), fetched).count() == 1
    assert crawl.expandable(items, pages, CrawlOptions(max_pages=2), fetched).count() == 0


def test_half_hour_recrawl(spark):
    p = page_frame(spark, [(1, "u", "pending")])
    r = spark.createDataFrame([(1, "not_modified")], "id bigint, kind string").select("id", "kind", F.lit(304).alias("http_status"), *[F.lit("v").alias(c) for c in ("title", "content_hash", "etag", "last_modified", "minio_key", "error")], F.lit(9).alias("content_length"))
    got = crawl.apply_results(p, r, now(), CrawlOptions(recrawl_hours=0.5)).first()
    assert got.next_crawl_at - got.last_crawled_at == dt.timedelta(minutes=30)


def test_windows_and_exposition(spark):
    base = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([(base + dt.timedelta(seconds=s), "ok", v) for s, v in ((0, 0.05), (10, 0.3), (400, 3.0))] + [(None, "ok", 1.0)], "ts timestamp, kind string, v double")
    got = {r.window_start.minute: r.value for r in monitor.windowed_quantile(df, "ts", "kind", "v", 0.5).collect()}
    assert got == {0: pytest.approx(0.1), 5: pytest.approx(2.0 + 3.0 * 0.5)}
    lines = monitor.exposition(spark.createDataFrame([('a"b\\c', 2), (None, 3), ("x", None)], "k string, n int"), "m", "k", "n").collect()
    assert {r.line for r in lines} == {'m{k="a\\"b\\\\c"} 2', 'm{k=""} 3'}


def test_outcomes(spark):
    df = spark.createDataFrame([(304, None), (200, None), (200, "not html"), (0, "x"), (None, None), (503, None)], "s int, e string")
    assert [r.o for r in df.select(crawl.fetch_outcome(F.col("s"), F.lit(False), F.col("e")).alias("o")).collect()] == ["not_modified", "success", "non_html_retry", "error", "error", "http_503"]


def test_metrics(spark):
    base = dt.datetime(2025, 1, 1)
    rows = [(base + dt.timedelta(seconds=s), "ok", v) for s, v in ((0, 0.05), (10, 0.3), (20, 0.3), (50, 60.0), (70, 3.0))] + [(base, "none", None)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string, v double")
    got = {(r.window_start.minute, r.kind): r.rate for r in monitor.rate(df, "ts", "kind").collect()}
    assert got[0, "ok"] == pytest.approx(4 / 60) and got[1, "ok"] == pytest.approx(1 / 60)
    assert monitor.gauge(df, "ts", "kind", "v").where("kind = 'ok'").orderBy("window_start").first().value == 60.0
    b = monitor.histogram(df, ["kind"], "v")
    assert {r.le: r.n for r in b.where("kind = 'ok'").collect()}[0.5] == 3
    q = {r.kind: r.value for r in monitor.quantile(b, ["kind"], 0.5).collect()}
    assert q == {"ok": pytest.approx(0.25 + 0.25 * (2.5 - 1) / 2)}
    assert monitor.quantile(b, ["kind"], 0.99).first().value == 30.0
