"""Structured Streaming forms of the crawl side: frontier source, seen-set, rate limiter, page states, metrics, index.

A checkpoint folder takes the place of consumer groups: offsets are claimed per micro-batch, a batch that didn't
commit is run again, and an entry is acknowledged by the commit. Sinks written in foreachBatch are keyed by the batch
number, so that a repeated batch replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.config import CrawlOptions, from_env
from corvane.functions.urls import host_of, normalize
from corvane.operators import index, monitor
from corvane.operators.crawl import due_for_recrawl, due_for_retry, fetched_page_count, frontier_items
from corvane.schemas import table_schema
from corvane.session import settle
from corvane.sources.stores import SEED_URLS


def frontier_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """The frontier as an append-only folder of Parquet files; late files are just later batches."""
    return spark.readStream.schema(table_schema("frontier")).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def enqueue(items: DataFrame, folder: str) -> None:
    """Appends entries; with entries read back it is a requeue. Nothing is ever deleted from the log."""
    items.write.mode("append").parquet(folder)


def add_if_new(entries: DataFrame, folder: str, checkpoint: str, put: Callable[[DataFrame, int], None] | None = None):
    """A writer that hands each normalised url on once, ever: the first entry of a key that no batch before had.

    The keys seen so far are a table in `folder`, one part per batch, read by an anti-join: exact, of any size, nothing
    in executor memory for long. A repeated batch reads the parts before it and replaces its own. `put` gets the new
    entries and the batch number.
    """
    spark = entries.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumn("key", normalize("url")).where(F.col("key").isNotNull())
        first = keyed.groupBy("key").agg(F.min(F.struct("entry_id", *[c for c in batch.columns if c != "entry_id"])).alias("e")).select("key", "e.*")
        if number:
            seen = spark.read.schema("key string, batch int").parquet(folder).where(F.col("batch") < number).select("key")
            first = first.join(seen, "key", "left_anti")
        first.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if put:
            put(spark.read.parquet(f"{folder}/batch={number}"), number)

    return entries.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def unseen_within(entries: DataFrame, event_time: str = "enqueued_at", watermark: str = "1 hour") -> DataFrame:
    """Each normalised url once within the watermark's horizon: bounded state; a url that comes back later is given again."""
    keyed = entries.withColumn("key", normalize("url")).where(F.col("key").isNotNull() & F.col(event_time).isNotNull())
    return keyed.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["key"])


def new_pages(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Stream-static anti-join: entries whose url pages doesn't have."""
    keyed = entries.withColumn("key", normalize("url")).where(F.col("key").isNotNull())
    known = pages.select(F.col("url").alias("key"), F.lit(True).alias("known")).distinct()
    return keyed.join(known, "key", "left").where(F.col("known").isNull()).drop("known")


def limit_rate(items: DataFrame, delay_ms: int = 3000, watermark: str = "10 minutes") -> DataFrame:
    """(domain, entry_id, ms, accepted) from (domain, entry_id, ms): accepted if the domain's last accepted entry lies
    at least delay_ms back.

    The state is one number per domain. It is dropped by event time, once the watermark has passed the delay: no entry
    that is still taken can lie within it. Entries later than the watermark are dropped.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["ms", "entry_id"])
        ok = []
        for when in rows["ms"].tolist():
            free = last is None or when >= last + delay_ms
            last = when if free else last
            ok.append(free)
        state.update((int(last),))
        state.setTimeoutTimestamp(max(int(last) + delay_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"domain": key[0], "entry_id": rows["entry_id"], "ms": rows["ms"], "accepted": ok})

    timed = items.where(F.col("domain").isNotNull() & F.col("ms").isNotNull()).withColumn("at", F.timestamp_millis("ms")).withWatermark("at", watermark)
    return timed.groupBy("domain").applyInPandasWithState(
        step, "domain string, entry_id string, ms bigint, accepted boolean", "last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def page_lifecycle(results: DataFrame, options: CrawlOptions | None = None) -> DataFrame:
    """(url, status, retry_count) after each batch from fetch results (url, seq, outcome): the page's state machine.

    Outcomes: started, success, not_modified, failure, permanent, skipped. Results of a batch are applied by seq. The
    retry count is kept for a page's life.
    """
    options = options or from_env(CrawlOptions)
    states = {"started": "in_progress", "success": "crawled", "not_modified": "not_modified", "permanent": "failed", "skipped": "skipped"}

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, retries = state.get if state.exists else ("pending", 0)
        for outcome in pd.concat(list(parts)).sort_values("seq")["outcome"].tolist():
            if outcome == "failure":
                retries += 1
                status = "failed" if retries > options.max_retries else "pending"
            else:
                status = states.get(outcome, status)
        state.update((status, int(retries)))
        yield pd.DataFrame({"url": [key[0]], "status": [status], "retry_count": [int(retries)]})

    return results.groupBy("url").applyInPandasWithState(
        step, "url string, status string, retry_count int", "status string, retries int", "update", GroupStateTimeout.NoTimeout
    )


def outcome_rates(events: DataFrame, ts: str = "ts", by: str = "event_type", watermark: str = "5 minutes") -> DataFrame:
    """Events per second in one-minute windows; a window is given out once the watermark has passed it."""
    return monitor.rate(events.withWatermark(ts, watermark), ts, by)


def ticker(spark: SparkSession, work: Callable[[], None], seconds: float):
    """A writer that does some work every so many seconds, driven by the clock alone."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, __: work()).trigger(processingTime=f"{seconds} seconds")


def as_entries(due: DataFrame, now: Column) -> DataFrame:
    """Frontier entries for pages due again; ids by time and page, so that a repeated tick gives the same ones."""
    ms = F.unix_millis(now)
    return due.select(
        F.concat(ms, F.lit("-"), "id").alias("entry_id"), "url", host_of("url").alias("domain"), F.col("depth").cast("string").alias("depth"),
        F.lit("").alias("parent_id"), now.alias("enqueued_at"),
    )


def retry_ticker(spark: SparkSession, read_pages: Callable[[], DataFrame], put: Callable[[DataFrame], None], now: Callable[[], Column], seconds: float | None = None):
    """The retry scheduler's loop: pages whose wait is over go to `put` as entries."""
    seconds = from_env(CrawlOptions).retry_poll_sec if seconds is None else seconds
    return ticker(spark, lambda: put(as_entries(due_for_retry(read_pages(), now()), now())), seconds)


def recrawl_ticker(spark: SparkSession, read_pages: Callable[[], DataFrame], put: Callable[[DataFrame], None], now: Callable[[], Column], seconds: float = 60.0):
    """The re-crawl scheduler's loop: pages due for another crawl go to `put` as entries."""
    return ticker(spark, lambda: put(as_entries(due_for_recrawl(read_pages(), now()), now())), seconds)


def sampler(spark: SparkSession, read_pages: Callable[[], DataFrame], read_entries: Callable[[], DataFrame], read_acked: Callable[[], DataFrame], gauges: dict, seconds: float = 5.0):
    """The sampler's loop: keeps the gauges queue_depth, pending_count and pages_crawled up to date."""

    def sample() -> None:
        row = frontier_counts(read_entries(), read_acked()).first()
        gauges.update(queue_depth=row.stream_length, pending_count=row.pending, pages_crawled=fetched_page_count(read_pages()).first().fetched)

    return ticker(spark, sample, seconds)


class Progress(StreamingQueryListener):
    """Counters of streaming queries by name, for exposition: batches and input rows so far, and rows a second of the last batch."""

    def __init__(self):
        self.counters: dict[str, dict[str, float]] = {}

    def onQueryStarted(self, event):
        self.counters.setdefault(event.name or str(event.id), {"batches": 0, "input_rows": 0, "rows_per_second": 0.0})

    def onQueryProgress(self, event):
        p = event.progress
        own = self.counters.setdefault(p.name or str(p.id), {"batches": 0, "input_rows": 0, "rows_per_second": 0.0})
        own["batches"] += 1
        own["input_rows"] += p.numInputRows
        own["rows_per_second"] = p.processedRowsPerSecond

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def seed_once(spark: SparkSession, folder: str, now: Column, urls: list[str] | None = None) -> bool:
    """Appends the seeds to an empty frontier; whether it did. A frontier that has any file was seeded before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(path) and len(files.listStatus(path)):
        return False
    rows = spark.createDataFrame(list(enumerate(urls or SEED_URLS)), "n long, raw string").select("n", normalize("raw").alias("url")).where(F.col("url").isNotNull())
    enqueue(rows.select(
        F.concat(F.unix_millis(now), F.lit("-"), "n").alias("entry_id"), "url", host_of("url").alias("domain"), F.lit("0").alias("depth"), F.lit("").alias("parent_id"), now.alias("enqueued_at")
    ), folder)
    return True


def success_count(results: DataFrame) -> DataFrame:
    """(successes): the running number of fetches that ended with a page, for the page cap; not_modified doesn't count."""
    return results.where(F.col("outcome") == "success").groupBy().agg(F.count("*").alias("successes"))


def maintain_index(texts: DataFrame, folder: str, checkpoint: str, key: str = "page_id", text: str = "text", parts: int = 64):
    """A writer that keeps an index up to date with a stream of changed page texts.

    folder/pages and folder/postings lie in `parts` parts by a hash of the page; a batch reads and rewrites only parts
    that hold one of its pages, as v=<batch>, and lists in folder/current which version of each part counts.
    folder/deltas gets what each batch does to document frequencies, terms_of sums them up. A repeated batch replaces its own.
    """
    spark = texts.sparkSession
    place = F.pmod(F.xxhash64("page_id"), F.lit(parts)).cast("int")
    kind, listing = "term string, page_id bigint, tf bigint", "part int, version int"

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(F.col(key).alias("page_id")).agg(F.max(text).alias("text"))  # of several texts of a page in a batch, one
        last = settle(last.withColumn("part", place))
        touched = sorted(r.part for r in last.select("part").distinct().collect())  # as many as there are parts, at most
        versions = {r.part: r.version for r in spark.read.schema(listing).parquet(f"{folder}/current/v={number - 1}").collect()} if number else {}
        paths = [f"{folder}/postings/v={versions[p]}/part={p}" for p in touched if p in versions]
        old = spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind)
        fresh = index.build_postings(last, "page_id", "text")
        kept, delta = index.reindexed(old, fresh, last.select("page_id"))
        new = kept.withColumn("part", place)
        new.repartition(len(touched) or 1, "part").sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/postings/v={number}")
        delta.write.mode("overwrite").parquet(f"{folder}/deltas/v={number}")
        written = [r.part for r in new.select("part").distinct().collect()]
        versions = {p: v for p, v in versions.items() if p not in touched} | {p: number for p in written}
        spark.createDataFrame(sorted(versions.items()), listing).coalesce(1).write.mode("overwrite").parquet(f"{folder}/current/v={number}")

    return texts.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def postings_of(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """(term, page_id, tf) of a maintained index after a batch."""
    versions = spark.read.schema("part int, version int").parquet(f"{folder}/current/v={number}").collect()
    paths = [f"{folder}/postings/v={r.version}/part={r.part}" for r in versions]
    kind = "term string, page_id bigint, tf bigint"
    return spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind)


def terms_of(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """(term, doc_freq) of a maintained index after a batch; terms that no page has any more stay with 0."""
    deltas = spark.read.schema("term string, lost bigint, won bigint, v int").option("basePath", f"{folder}/deltas").parquet(f"{folder}/deltas").where(F.col("v") <= number)
    return deltas.groupBy("term").agg(F.greatest(F.sum(F.col("won") + F.col("lost")), F.lit(0)).alias("doc_freq"))


def frontier_counts(entries: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """One row: stream_length counts all entries ever added, pending those not acknowledged."""
    known = frontier_items(entries).select("entry_id").join(acknowledged.select("entry_id").withColumn("done", F.lit(True)), "entry_id", "left")
    return known.agg(F.count("*").alias("stream_length"), F.count_if(F.col("done").isNull()).alias("pending"))
