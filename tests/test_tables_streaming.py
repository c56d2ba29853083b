import datetime as dt

from pyspark.sql import functions as F

from corvane.operators import index
from corvane.schemas import table_schema
from corvane.sources import stores, tables
from corvane.streaming import jobs


def stamp(day):
    return dt.datetime(2025, 1, day)


def test_current_views(spark):
    pages = spark.createDataFrame([(1, "a", stamp(1), None), (1, "b", stamp(2), 0.5), (1, "b", stamp(2), 0.5), (2, "c", None, float("nan")), (None, "z", stamp(9), 1.0)], "id bigint, url string, last_crawled_at timestamp, pagerank double")
    got = {r.id: r.url for r in tables.current_pages(pages, "url").collect()}
    assert got == {1: "b", 2: "c"}
    objects = spark.createDataFrame([("k", "old", stamp(1)), ("k", "new", stamp(3)), ("k", "new", stamp(3)), (None, "x", stamp(1))], "minio_key string, html string, stored_at timestamp")
    assert [tuple(r) for r in tables.current_bodies(objects).collect()] == [("k", "new")]
    hosts = tables.page_hosts(pages.withColumn("url", F.concat(F.lit("http://H:81/"), "url")))
    assert sorted((r.id, r.host, r.pagerank) for r in hosts.collect()) == [(1, "h", 0.5), (2, "h", 0.0)]


def test_clean_postings(spark):
    rows = [(" Page", 1, 2), ("page", 1, 2), ("ＰＡＧＥ", 1, 3), ("x", 1, 0), ("x", 2, None), (None, 3, 1), ("é", None, 1), ("  ", 4, 1)]
    got = tables.clean_postings(spark.createDataFrame(rows, "term string, page_id bigint, tf int")).collect()
    assert [tuple(r) for r in got] == [("page", 1, 3)]
    assert tables.clean_postings(spark.createDataFrame([], "term string, page_id bigint, tf int")).count() == 0


def test_stores(spark, tmp_path):
    assert stores.seeds(spark).count() == 8
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "1.html").write_bytes(b"caf\xc3\xa9 \xff")
    assert [tuple(r) for r in stores.read_bodies(spark, str(tmp_path)).collect()] == [("pages/1.html", "café �")]
    raw = spark.createDataFrame(
        [("u", 200, bytearray(b"<p>x"), "text/html; charset=utf-8", None), ("v", 200, bytearray(b"%PDF"), "application/pdf", None), ("w", 304, None, None, None), ("z", None, None, None, None)],
        "url string, status int, body binary, content_type string, charset string",
    )
    got = {r.url: r for r in stores.shape_fetch_result(raw).collect()}
    assert got["u"].html == "<p>x" and got["v"].html is None and got["v"].error == "not html" and got["w"].not_modified and got["z"].status == 0 and got["z"].error
    cut = {r.url: r for r in stores.shape_fetch_result(raw, 2).collect()}
    assert cut["u"].html == "<p" and cut["u"].content_length == 2
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "minio_key string, html string")
    assert sorted(map(tuple, stores.put_bodies(old, spark.createDataFrame([("b", "3")], old.schema)).collect())) == [("a", "1"), ("b", "3")]
    stores.write_snapshot(old, str(tmp_path / "snap"), "minio_key")
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 2


def run(spark, stream, tmp_path, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def test_rate_stream(spark, tmp_path):
    rows = [("d", f"e{t}", 1_000_000 + t) for t in (0, 1000, 3500, 5000, 7000)]
    spark.createDataFrame(rows, "domain string, entry_id string, ms bigint").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("domain string, entry_id string, ms bigint").parquet(str(tmp_path / "in"))
    got = run(spark, jobs.limit_rate(stream), tmp_path, "rates", "append").where("accepted").orderBy("ms").collect()
    assert [r.ms - 1_000_000 for r in got] == [0, 3500, 7000]


def test_rate_state_is_kept_by_event_time(spark, tmp_path):
    """On a backlog, batches come fast but entries lie close: an entry inside of the delay is refused in a later batch, too."""
    ddl = "domain string, entry_id string, ms bigint"
    for k, part in enumerate(([("d", "a", 1000)], [("d", "b", 3000), ("x", "y", 10_000_000)], [("d", "c", 9_999_000)], [("d", "e", 10_001_000), ("d", "f", 10_003_000)])):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = jobs.limit_rate(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None, k
    got = {r.entry_id: r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": True, "b": False, "y": True, "c": True, "e": False, "f": True}


def test_lifecycle_stream(spark, tmp_path):
    rows = [("u", 1, "started"), ("u", 2, "failure"), ("u", 3, "failure"), ("u", 4, "success"), *[("w", i, "failure") for i in range(4)], ("s", 0, "skipped")]
    spark.createDataFrame(rows, "url string, seq bigint, outcome string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, seq bigint, outcome string").parquet(str(tmp_path / "in"))
    got = {r.url: (r.status, r.retry_count) for r in run(spark, jobs.page_lifecycle(stream), tmp_path, "life", "update").collect()}
    assert got == {"u": ("crawled", 2), "w": ("failed", 4), "s": ("skipped", 0)}


def test_frontier_stream(spark, tmp_path):
    folder = str(tmp_path / "frontier")
    rows = [("1-0", "HTTP://A/x", "a", "0", "", stamp(1)), ("2-0", "http://a/x", "a", "0", "", stamp(1)), ("3-0", "http://a/y", "a", "0", "", stamp(1)), ("4-0", None, None, None, None, stamp(1))]
    items = spark.createDataFrame(rows, table_schema("frontier"))
    jobs.enqueue(items, folder)
    got = run(spark, jobs.unseen_within(jobs.frontier_stream(spark, folder)), tmp_path, "unseen", "append")
    assert sorted(r.key for r in got.collect()) == ["http://a/x", "http://a/y"]
    known = spark.createDataFrame([("http://a/x",)], "url string")
    fresh = run(spark, jobs.new_pages(jobs.frontier_stream(spark, folder), known), tmp_path, "fresh", "append")
    assert [r.key for r in fresh.collect()] == ["http://a/y"]
    row = jobs.frontier_counts(items, items.where("entry_id = '1-0'")).first()
    assert (row.stream_length, row.pending) == (4, 3)


def drain(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_add_if_new_never_forgets(spark, tmp_path):
    folder, got = str(tmp_path / "frontier"), {}
    days = [[("1-0", "http://a/x", 1), ("1-1", "HTTP://A/x#f", 1)], [("9-0", "http://a/x", 20), ("9-1", "http://a/y", 20), ("9-2", None, 20)], [("7-0", "http://a/y", 2)]]
    for part in days:
        jobs.enqueue(spark.createDataFrame([(e, u, "a", "0", "", stamp(d)) for e, u, d in part], table_schema("frontier")).coalesce(1), folder)
        stream = jobs.frontier_stream(spark, folder, 1)
        drain(jobs.add_if_new(stream, str(tmp_path / "seen"), str(tmp_path / "ck"), lambda df, n: got.update({n: [r.entry_id for r in df.collect()]})))
    assert got == {0: ["1-0"], 1: ["9-1"], 2: []}


def test_index_stream(spark, tmp_path):
    src, out = str(tmp_path / "texts"), str(tmp_path / "index")
    ddl = "page_id bigint, text string"
    for part in ([(1, "alpha beta"), (2, "beta"), (3, "delta")], [(1, "beta gamma")], [(3, None)]):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(src)
        drain(jobs.maintain_index(stream, out, str(tmp_path / "ck"), parts=8))
    want = index.build_postings(spark.createDataFrame([(1, "beta gamma"), (2, "beta")], ddl), "page_id", "text")
    assert sorted(map(tuple, jobs.postings_of(spark, out, 2).collect())) == sorted(map(tuple, want.select("term", "page_id", "tf").collect()))
    assert {r.term: r.doc_freq for r in jobs.terms_of(spark, out, 2).collect()} == {"alpha": 0, "beta": 2, "gamma": 1, "delta": 0}
    assert {r.term: r.doc_freq for r in jobs.terms_of(spark, out, 0).collect()} == {"alpha": 1, "beta": 2, "delta": 1}
    parts = {r.part: r.version for r in spark.read.parquet(f"{out}/current/v=2").collect()}
    assert set(parts.values()) <= {0, 1} and 0 in parts.values()  # untouched parts weren't written again


def tick(writer, wait, done):
    import time

    q = writer.start()
    try:
        until = time.time() + wait
        while time.time() < until and not done():
            time.sleep(0.2)
        assert q.exception() is None and done()
    finally:
        q.stop()


def test_schedulers_and_sampler(spark):
    ddl = "id bigint, url string, depth int, status string, next_crawl_at timestamp, next_retry_at timestamp"
    pages = spark.createDataFrame([(1, "http://a/1", 1, "crawled", stamp(1), None), (2, "http://a/2", 0, "pending", None, stamp(1)), (3, "http://a/3", 0, "crawled", stamp(9), None)], ddl)
    now, got, gauges = lambda: F.lit("2025-01-05").cast("timestamp"), [], {}
    tick(jobs.retry_ticker(spark, lambda: pages, lambda df: got.append(("retry", [(r.url, r.domain, r.depth) for r in df.collect()])), now, 1), 60, lambda: bool(got))
    tick(jobs.recrawl_ticker(spark, lambda: pages, lambda df: got.append(("again", [(r.url, r.domain, r.depth) for r in df.collect()])), now, 1), 60, lambda: got[-1][0] == "again")
    assert got[0] == ("retry", [("http://a/2", "a", "0")]) and got[-1] == ("again", [("http://a/1", "a", "1")])
    entries = jobs.as_entries(pages, now())
    assert set(entries.columns) == set(table_schema("frontier").names) and entries.select("entry_id").distinct().count() == 3
    tick(jobs.sampler(spark, lambda: pages, lambda: entries, lambda: entries.limit(1), gauges, 1), 60, lambda: bool(gauges))
    assert gauges == {"queue_depth": 3, "pending_count": 2, "pages_crawled": 2}


def test_seed_once_and_success_count(spark, tmp_path):
    folder, now = str(tmp_path / "frontier"), F.lit("2025-01-05").cast("timestamp")
    assert jobs.seed_once(spark, folder, now) and not jobs.seed_once(spark, folder, now)
    seeded = spark.read.parquet(folder)
    assert seeded.count() == 8 and seeded.where("domain is null or depth <> '0'").count() == 0
    results = str(tmp_path / "results")
    spark.createDataFrame([("success",), ("failure",), ("success",), ("not_modified",)], "outcome string").write.parquet(results)
    stream = spark.readStream.schema("outcome string").parquet(results)
    assert run(spark, jobs.success_count(stream), tmp_path, "successes", "complete").first().successes == 2


def test_progress_counters(spark, tmp_path):
    from types import SimpleNamespace as Event

    seen = jobs.Progress()
    seen.onQueryStarted(Event(name="q", id=1))
    for rows in (3, 4):
        seen.onQueryProgress(Event(progress=Event(name="q", id=1, numInputRows=rows, processedRowsPerSecond=2.0 * rows)))
    seen.onQueryProgress(Event(progress=Event(name=None, id=2, numInputRows=1, processedRowsPerSecond=1.0)))
    seen.onQueryTerminated(Event())
    assert seen.counters == {"q": {"batches": 2, "input_rows": 7, "rows_per_second": 8.0}, "2": {"batches": 1, "input_rows": 1, "rows_per_second": 1.0}}
    live = jobs.Progress()  # Spark takes it for a listener and calls it when a query starts
    spark.streams.addListener(live)
    try:
        spark.createDataFrame([("success",)], "outcome string").write.parquet(str(tmp_path / "in"))
        run(spark, jobs.success_count(spark.readStream.schema("outcome string").parquet(str(tmp_path / "in"))), tmp_path, "listened", "complete")
    finally:
        spark.streams.removeListener(live)
    assert "listened" in live.counters


def test_bodies_are_joined_without_sorting_them(spark, tmp_path):
    rows = [(f"k{i % 5}", f"body {i}", stamp(1 + i % 9)) for i in range(45)] * 2 + [("k0", "late", None)]
    spark.createDataFrame(rows, "minio_key string, html string, stored_at timestamp").write.parquet(str(tmp_path / "html_objects.parquet"))
    pages = spark.createDataFrame([(i, f"u{i}", f"k{i % 3}", stamp(1)) for i in range(40)], "id bigint, url string, minio_key string, last_crawled_at timestamp")
    stored = tables.table(spark, str(tmp_path), "html_objects")
    plan = tables.bodies_of_pages(pages, stored, "url")
    want = {k: max((t, b) for key, b, t in rows if key == k and t)[1] for k in ("k0", "k1", "k2")}
    got = plan.collect()
    assert len(got) == 40 and all(r.html == want[f"k{r.id % 3}"] and r.url == f"u{r.id}" for r in got)
    assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.html for r in tables.current_bodies(stored).collect())[0].startswith("body")


def test_metrics_stream(spark, tmp_path):
    rows = [(stamp(1) + dt.timedelta(seconds=s), "ok") for s in (0, 10, 70, 4000)]
    spark.createDataFrame(rows, "ts timestamp, event_type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    got = run(spark, jobs.outcome_rates(stream), tmp_path, "mrates", "append").orderBy("window_start").collect()
    assert [round(r.rate * 60) for r in got][:2] == [2, 1]
