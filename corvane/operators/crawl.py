"""Crawl state: the page table's transitions, the frontier, retries, re-crawls, rate limits, robots rules.

Each operator is a function from tables to the next table; a snapshot takes the place of row updates. `now` is always
an argument, so that a repeated run gives the same rows.
"""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.config import CrawlOptions
from corvane.functions.urls import disallowed_address, host_of, normalize
from corvane.operators.skew import heavy_keys, salted_join
from corvane.session import settle

ERROR_CHARS = 2000
FETCHED = ("crawled", "not_modified")


# -- scalar rules ---------------------------------------------------------------------------------------------------


def retry_outcome(retry_count: Column, options: CrawlOptions = CrawlOptions()) -> Column:
    """struct(outcome, delay) for a count that includes the failure just met: capped doubling, then failed."""
    delay = F.least(F.lit(options.retry_base_sec) * F.pow(F.lit(2.0), retry_count - 1), F.lit(options.retry_cap_sec))
    gone = retry_count > options.max_retries
    return F.struct(F.when(gone, F.lit("failed")).otherwise(F.lit("retry_scheduled")).alias("outcome"), F.when(~gone, delay).alias("delay"))


def crawl_delay(robots_delay: Column, default: float = CrawlOptions.crawl_delay_sec) -> Column:
    """The robots' delay, never below the default; the default where there is none."""
    return F.greatest(F.coalesce(robots_delay, F.lit(default)), F.lit(default))


def limiter_ttl_ms(delay: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(delay * 1000))


def seconds_until_free(ttl_ms: Column) -> Column:
    """Null and negative remaining times are 0."""
    return F.greatest(F.lit(0.0), F.coalesce(ttl_ms / 1000, F.lit(0.0)))


def is_html(content_type: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return kind.contains("text/html") | kind.contains("xhtml")


def fetch_outcome(status: Column, not_modified: Column, error: Column) -> Column:
    """not_modified, success, error (no response), http_<status>, or html_retry for a 200 that isn't html."""
    return (
        F.when(not_modified | (status == 304), F.lit("not_modified"))
        .when((status == 200) & error.isNull(), F.lit("success"))
        .when(F.coalesce(status, F.lit(0)) == 0, F.lit("error"))
        .when(status == 200, F.lit("non_html_retry"))
        .otherwise(F.concat(F.lit("http_"), status.cast("string")))
    )


def decoded(body: Column, charset: Column, truncated: Column) -> Column:
    """Text of a body: UTF-8 if it was cut off or the charset is unknown; bad bytes are replaced."""
    known = F.upper(F.coalesce(charset, F.lit("UTF-8")))
    return F.when(~truncated & known.isin("ISO-8859-1", "LATIN-1", "LATIN1"), F.decode(body, "ISO-8859-1")).otherwise(
        F.make_valid_utf8(body.cast("string"))
    )


# -- upserts and lookups --------------------------------------------------------------------------------------------


def ensure_domains(domains: DataFrame, hosts: DataFrame, delay: float = CrawlOptions.crawl_delay_sec) -> DataFrame:
    """domains with a row for each host that had none; existing rows are untouched, null hosts ignored."""
    new = hosts.select("domain").where(F.col("domain").isNotNull()).distinct().join(domains, "domain", "left_anti")
    columns = {"crawl_delay_sec": F.lit(delay), "disallow_all": F.lit(False)}
    return domains.unionByName(new.select("domain", *[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in domains.schema if f.name != "domain"]))


def update_robots(domains: DataFrame, fetched: DataFrame) -> DataFrame:
    """domains with the four robots columns of `fetched` (one row per domain) put in place of the old ones."""
    own = ["robots_txt", "robots_fetched_at", "crawl_delay_sec", "disallow_all"]
    new = fetched.select("domain", *[F.col(c).alias(f"_{c}") for c in own], F.lit(True).alias("_new"))
    both = domains.join(new, "domain", "full_outer")
    return both.select("domain", *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in own])


def dense_ids(rows: DataFrame, order: list[str], first: Column) -> DataFrame:
    """rows with id = first, first + 1, ... in the given total order, numbered in parallel.

    Range partitioning sorts the rows; each range is numbered by itself and shifted by the sizes of those before, of
    which there is one per task. `first` may use columns of the rows.
    """
    ranged = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    shift = sizes.withColumn("_shift", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_n", within).join(F.broadcast(shift.select("_part", "_shift")), "_part").withColumn(
        "id", (first + F.col("_shift") + F.col("_n")).cast("long")
    ).drop("_part", "_shift", "_n")


def get_or_create_pages(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(url, id, created) for each distinct url of `found` (url, seq): known ones keep their id, new ones get the next.

    New ids follow the order of first appearance. Null urls are ignored.
    """
    first = found.where(F.col("url").isNotNull()).groupBy("url").agg(F.min("seq").alias("seq"))
    known = pages.where(F.col("url").isNotNull()).groupBy("url").agg(F.min("id").alias("id"))
    top = pages.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    new = first.join(known, "url", "left_anti").crossJoin(F.broadcast(top))
    made = dense_ids(new, ["seq", "url"], F.col("_top") + 1).select("url", "id", F.lit(True).alias("created"))
    return first.join(known, "url").select("url", "id", F.lit(False).alias("created")).unionByName(made)


def conditional_headers(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, etag, last_modified): validators of the urls; nulls for unknown ones."""
    return urls.select("url").distinct().join(pages.select("url", "etag", "last_modified"), "url", "left")


def insert_links(links: DataFrame, pages: DataFrame, found: DataFrame) -> DataFrame:
    """New rows (src_page_id, dst_url, dst_page_id, anchor_text) of `found` (src_page_id, dst_url, anchor_text, pos).

    Existing pairs and repeated ones after the first are ignored; targets are looked up among the pages of now.
    """
    first = found.groupBy("src_page_id", "dst_url").agg(F.min(F.struct("pos", "anchor_text")).alias("f"))
    fresh = first.join(links, ["src_page_id", "dst_url"], "left_anti")
    known = pages.where(F.col("url").isNotNull()).groupBy(F.col("url").alias("dst_url")).agg(F.min("id").alias("dst_page_id"))
    heavy = heavy_keys(fresh.groupBy("dst_url").agg(F.count("*").alias("n")), "dst_url", "n")
    return salted_join(fresh, known, "dst_url", heavy, "left").select("src_page_id", "dst_url", "dst_page_id", F.col("f.anchor_text").alias("anchor_text"))


# -- page states ----------------------------------------------------------------------------------------------------


def apply_results(pages: DataFrame, results: DataFrame, now: Column, options: CrawlOptions = CrawlOptions()) -> DataFrame:
    """pages after one batch of fetch results, one per id: (id, kind, http_status, title, content_hash, etag,
    last_modified, content_length, minio_key, error), kind being success, not_modified, failure, permanent or skipped.

    A success keeps the first crawl time and the retry count; a failure raises the count and is scheduled again or
    given up; a skip leaves the crawl times alone. Pages without a result pass through.

    Results are joined by merge, which can spill: columns computed after a shuffle don't count in the size that an
    adaptive plan knows, so that it would broadcast narrow rows that are long texts by then.
    """
    new = results.select("id", *[F.col(c).alias(f"_{c}") for c in results.columns if c != "id"])
    j = pages.join(new.hint("merge"), "id", "left")
    kind, count = F.col("_kind"), F.coalesce("retry_count", F.lit(0)) + 1
    retry = retry_outcome(count, options)
    again = (kind == "failure") & (retry["outcome"] == "retry_scheduled")
    fetched = kind.isin("success", "not_modified")
    recrawl = now + F.make_dt_interval(secs=F.lit(float(options.recrawl_hours) * 3600).cast("decimal(18,6)"))
    of = lambda c: F.when(kind == "success", F.col(f"_{c}")).otherwise(F.col(c))
    values = {
        "status": F.when(kind == "success", "crawled").when(kind == "not_modified", "not_modified").when(again, "pending")
        .when(kind.isin("failure", "permanent"), "failed").when(kind == "skipped", "skipped").otherwise(F.col("status")),
        "http_status": F.when(kind.isin("success", "not_modified", "failure", "permanent"), F.col("_http_status")).otherwise(F.col("http_status")),
        "first_crawled_at": F.when(kind == "success", F.coalesce("first_crawled_at", now)).otherwise(F.col("first_crawled_at")),
        "last_crawled_at": F.when(kind.isin("success", "not_modified", "failure", "permanent"), now).otherwise(F.col("last_crawled_at")),
        "next_crawl_at": F.when(fetched, recrawl).when(kind.isin("failure", "permanent"), F.lit(None)).otherwise(F.col("next_crawl_at")),
        "error": F.when(fetched, F.lit(None)).when(kind.isNotNull(), F.substring("_error", 1, ERROR_CHARS)).otherwise(F.col("error")),
        "retry_count": F.when(kind == "failure", count).otherwise(F.col("retry_count")),
        "next_retry_at": F.when(again, now + F.make_dt_interval(secs=retry["delay"])).when(kind.isNotNull(), F.lit(None)).otherwise(F.col("next_retry_at")),
    } | {c: of(c) for c in ("title", "content_hash", "etag", "last_modified", "content_length", "minio_key")}
    return j.select(*[values[c].cast(t).alias(c) if c in values else F.col(c) for c, t in pages.dtypes])


def mark_in_progress(pages: DataFrame, ids: DataFrame) -> DataFrame:
    hit = pages.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumn("status", F.when(F.col("_hit"), F.lit("in_progress")).otherwise(F.col("status"))).drop("_hit")


def fetched_page_count(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count_if(F.col("status").isin(*FETCHED)).alias("fetched"))


def due(pages: DataFrame, column: str, statuses: tuple[str, ...], now: Column, limit: int) -> DataFrame:
    """The pages to claim next: time reached, earliest first, ties by id."""
    return pages.where(F.col("status").isin(*statuses) & (F.col(column) <= now)).orderBy(F.asc(column), F.asc("id")).limit(limit)


def due_for_recrawl(pages: DataFrame, now: Column, limit: int = 50) -> DataFrame:
    return due(pages, "next_crawl_at", FETCHED, now, limit)


def due_for_retry(pages: DataFrame, now: Column, limit: int = 50) -> DataFrame:
    return due(pages, "next_retry_at", ("pending",), now, limit)


def claim(pages: DataFrame, claimed: DataFrame, column: str) -> DataFrame:
    """pages with the due time of the claimed ones cleared, so that no other batch claims them."""
    hit = pages.join(claimed.select("id").withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumn(column, F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(column))).drop("_hit")


# -- frontier -------------------------------------------------------------------------------------------------------


def frontier_items(frontier: DataFrame) -> DataFrame:
    """(entry_id, ms, seq, url, domain, depth, parent_id): wire strings typed, entries once each.

    A missing depth is 0, an empty parent null; numbers that can't be read likewise.
    """
    part = lambda i: F.try_element_at(F.split("entry_id", "-"), F.lit(i)).try_cast("long")
    once = frontier.where(F.col("entry_id").isNotNull()).groupBy("entry_id").agg(
        *[F.min(c).alias(c) for c in ("url", "domain", "depth", "parent_id")]
    )
    return once.select(
        "entry_id", part(1).alias("ms"), part(2).alias("seq"), normalize("url").alias("url"), F.nullif("domain", F.lit("")).alias("domain"),
        F.coalesce(F.col("depth").try_cast("int"), F.lit(0)).alias("depth"), F.col("parent_id").try_cast("long").alias("parent_id"),
    )


def expandable(items: DataFrame, pages: DataFrame, options: CrawlOptions = CrawlOptions(), fetched: DataFrame | None = None) -> DataFrame:
    """Items to follow: url readable, parent known and below the depth limit, on the parent's host unless allowed.

    With `fetched`, the one row of fetched_page_count, nothing is followed once it has reached max_pages.
    """
    parents = pages.select(F.col("id").alias("parent_id"), host_of("url").alias("_host"), F.col("depth").alias("_depth"))
    joined = items.where(F.col("url").isNotNull()).join(parents, "parent_id")
    near = joined.where(F.col("_depth") < options.max_depth)
    if not options.allow_offsite_links:
        near = near.where(host_of("url") == F.col("_host"))
    if fetched is not None:
        near = near.crossJoin(F.broadcast(fetched.select((F.col("fetched") < options.max_pages).alias("_more")))).where("_more").drop("_more")
    return near.drop("_host", "_depth")


def unseen(items: DataFrame, pages: DataFrame) -> DataFrame:
    """The first item of each url that pages doesn't have: exact, by anti-join."""
    first = items.where(F.col("url").isNotNull()).groupBy("url").agg(F.min(F.struct("ms", "seq", "entry_id")).alias("f"))
    return first.select("url", F.col("f.entry_id").alias("entry_id")).join(pages.select("url"), "url", "left_anti")


def claim_entries(entries: DataFrame, delivered: DataFrame, now_ms: int, timeout_ms: int, count: int) -> DataFrame:
    """Entries for the next consumer: those idle for the timeout first; only if there are none, undelivered ones.

    `entries` (entry_id, ms, seq), `delivered` (entry_id, claimed_ms, acked). An acknowledged entry never returns.
    """
    joined = entries.join(delivered, "entry_id", "left")
    idle = joined.where(~F.col("acked") & (F.col("claimed_ms") + timeout_ms <= now_ms))
    fresh = joined.where(F.col("claimed_ms").isNull())
    some = idle.limit(1).agg((F.count("*") > 0).alias("_some"))
    chosen = idle.withColumn("_idle", F.lit(True)).unionByName(fresh.withColumn("_idle", F.lit(False))).crossJoin(F.broadcast(some))
    return chosen.where(F.col("_idle") == F.col("_some")).orderBy("ms", "seq").limit(count).select("entry_id", "_idle")


def accept_by_rate(items: DataFrame, domain: str, ms: str, delay_ms: str, tie: str) -> DataFrame:
    """items with accepted: true where the last accepted item of the domain lies at least delay_ms back.

    Rejected items don't extend the wait. The rule is sequential per domain: its rows are sorted within a partition
    and streamed in batches, a task keeping one number, the last accepted time; nothing is collected.
    """
    names = items.columns

    def run(batches):
        at, last = None, None
        for batch in batches:
            d, t, w = (batch.column(c).to_pylist() for c in (domain, ms, delay_ms))
            ok = np.zeros(len(d), bool)
            for i, (who, when, wait) in enumerate(zip(d, t, w)):
                if who != at:
                    at, last = who, None
                if when is not None and (last is None or when >= last + wait):
                    ok[i], last = True, when
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(ok)], names=[*names, "accepted"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in items.dtypes)
    placed = items.where(F.col(domain).isNotNull()).repartition(domain).sortWithinPartitions(domain, ms, tie)
    return placed.mapInArrow(run, f"{kinds}, accepted boolean")


# -- robots and addresses -------------------------------------------------------------------------------------------


def robots_rules(fetched: DataFrame, now: Column, agent: str = "*", default: float = CrawlOptions.crawl_delay_sec) -> DataFrame:
    """(domain, robots_txt, robots_fetched_at, crawl_delay_sec, disallow_all) from fetches (domain, status, body), for update_robots.

    Status 200 gives rules, 401 and 403 forbid all, anything else, a null status included, neither. The delay is that of
    the text's group for the agent, never below the default, which stands where there is none.
    """
    text = F.when(F.col("status") == 200, F.col("body"))
    rows = fetched.select("domain", text.alias("robots_txt"), F.coalesce(F.col("status").isin(401, 403), F.lit(False)).alias("disallow_all"))

    def run(batches):
        delays: dict = {None: None}
        for batch in batches:
            out = []
            for txt in batch.column("robots_txt").to_pylist():
                if txt not in delays:
                    if len(delays) > 10_000:
                        delays = {None: None}
                    parser = RobotFileParser()
                    parser.parse(txt.splitlines())
                    delays[txt] = parser.crawl_delay(agent)
                out.append(None if delays[txt] is None else float(delays[txt]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=["domain", "robots_txt", "disallow_all", "delay"])

    parsed = rows.mapInArrow(run, "domain string, robots_txt string, disallow_all boolean, delay double")
    return parsed.select("domain", "robots_txt", now.alias("robots_fetched_at"), crawl_delay(F.col("delay"), default).alias("crawl_delay_sec"), "disallow_all")


def robots_allow(urls: DataFrame, domains: DataFrame, agent: str = "*") -> DataFrame:
    """(url, domain, allowed) of distinct urls by their host's rules; hosts without rules allow all.

    Rules are joined by host, parsed once per batch and text.
    """
    hosts = urls.select("url", host_of("url").alias("domain")).where(F.col("domain").isNotNull()).distinct()
    rules = domains.groupBy("domain").agg(F.max("robots_txt").alias("robots_txt"), F.max("disallow_all").alias("disallow_all"))

    def run(batches):
        parsed: dict = {}
        for batch in batches:
            out = []
            for url, text, never in zip(*(batch.column(c).to_pylist() for c in ("url", "robots_txt", "disallow_all"))):
                if text not in parsed:
                    if len(parsed) > 10_000:
                        parsed.clear()
                    parsed[text] = RobotFileParser()
                    parsed[text].parse((text or "").splitlines())
                out.append(not never and parsed[text].can_fetch(agent, url))
            yield pa.RecordBatch.from_arrays([batch.column("url"), batch.column("domain"), pa.array(out, pa.bool_())], names=["url", "domain", "allowed"])

    heavy = heavy_keys(hosts.groupBy("domain").agg(F.count("*").alias("n")), "domain", "n")
    return salted_join(hosts, rules, "domain", heavy, "left").select("url", "domain", "robots_txt", "disallow_all").mapInArrow(
        run, "url string, domain string, allowed boolean"
    )


def safe_addresses(resolved: DataFrame) -> DataFrame:
    """(host, addresses, reachable) from (host, ip) rows: addresses that may be reached; none left is not reachable."""
    checked = resolved.withColumn("_bad", disallowed_address("ip"))
    return checked.groupBy("host").agg(F.sort_array(F.collect_set(F.when(~F.col("_bad"), F.col("ip")))).alias("addresses")).withColumn(
        "reachable", F.size("addresses") > 0
    )

