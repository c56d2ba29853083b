"""Queries on crawl state: urls, frontier, page states, retries, re-crawls, rate limits, robots, addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.config import CrawlOptions
from corvane.functions.urls import disallowed_address, host_of, normalize
from corvane.operators import crawl
from corvane.plans.registry import HOST, NUM_PAGES, query
from corvane.sources.tables import current_pages, table

NOW = "2025-02-01 00:00:00"
now = lambda: F.lit(NOW).cast("timestamp")


def norm_sql(u: str, keys: str, source: str) -> str:
    """CTEs ending in `k`: the keys and the normal form of u (null if there is none)."""
    return rf"""e AS (SELECT {keys}, trim({u}, E' \t\n\r') AS u FROM {source}),
    s AS (SELECT * EXCLUDE (u), lower(regexp_extract(u, '^([a-zA-Z]+)://([^/?#]*)', 1)) AS scheme,
        lower(regexp_replace(regexp_extract(u, '^([a-zA-Z]+)://([^/?#]*)', 2), '^.*@', '')) AS host,
        regexp_replace(regexp_replace(u, '#.*$', ''), '^[a-zA-Z]+://[^/?#]*', '') AS rest FROM e),
    k AS (SELECT * EXCLUDE (scheme, host, rest), CASE WHEN scheme IN ('http', 'https') AND host <> '' THEN scheme || '://' ||
        CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '') ELSE regexp_replace(host, ':443$', '') END ||
        CASE WHEN rest = '' OR rest[1] = '?' THEN '/' || rest ELSE rest END END AS key FROM s)"""


ITEMS = norm_sql("url", "entry_id, split_part(entry_id, '-', 1)::BIGINT AS ms, split_part(entry_id, '-', 2)::BIGINT AS seq, nullif(domain, '') AS domain, coalesce(try_cast(depth AS INT), 0) AS depth, try_cast(nullif(parent_id, '') AS BIGINT) AS parent_id", "(SELECT DISTINCT entry_id, url, domain, depth, parent_id FROM frontier)")


def items(spark, where):
    return crawl.frontier_items(table(spark, where, "frontier"))


def pages(spark, where, *columns):
    return current_pages(table(spark, where, "pages"), *columns)


@query("normalize_url", f"WITH {norm_sql('url', 'url AS raw', '(SELECT DISTINCT url FROM frontier WHERE url IS NOT NULL)')} SELECT raw, key AS url FROM k")
def normalize_url(spark, where):
    return table(spark, where, "frontier").where(F.col("url").isNotNull()).select("url").distinct().select(F.col("url").alias("raw"), normalize("url").alias("url"))


@query("get_domain", f"WITH {NUM_PAGES} SELECT id, {HOST.format('url')} AS host, sha256(url) AS url_hash, domain IS NOT DISTINCT FROM {HOST.format('url')} AS same FROM cur")
def get_domain(spark, where):
    p = pages(spark, where, "url", "domain")
    return p.select("id", host_of("url").alias("host"), F.sha2("url", 256).alias("url_hash"), F.col("domain").eqNullSafe(host_of("url")).alias("same"))


@query("frontier_items", f"WITH {ITEMS} SELECT entry_id, ms, seq, key AS url, domain, depth, parent_id FROM k")
def frontier_items(spark, where):
    return items(spark, where)


@query(
    "frontier_expandable",
    f"""WITH {NUM_PAGES}, {ITEMS} SELECT entry_id FROM k JOIN cur p ON p.id = parent_id WHERE key IS NOT NULL AND p.depth < 2 AND {HOST.format('key')} = {HOST.format('p.url')}""",
)
def frontier_expandable(spark, where):
    return crawl.expandable(items(spark, where), pages(spark, where, "url", "depth")).select("entry_id")


@query(
    "dedup_seen",
    f"""WITH {ITEMS}, f AS (SELECT key AS url, entry_id, row_number() OVER (PARTITION BY key ORDER BY ms, seq, entry_id) AS r FROM k WHERE key IS NOT NULL)
    SELECT url, entry_id FROM f WHERE r = 1 AND url NOT IN (SELECT url FROM pages)""",
)
def dedup_seen(spark, where):
    return crawl.unseen(items(spark, where), table(spark, where, "pages"))


@query(
    "get_or_create_page",
    f"""WITH {ITEMS}, f AS (SELECT key AS url, min(ms * 1000 + seq) AS seq FROM k WHERE key IS NOT NULL GROUP BY 1), o AS (SELECT url, min(id) AS id FROM pages GROUP BY 1)
    SELECT url, id, false AS created FROM f JOIN o USING (url) UNION ALL
    SELECT url, (SELECT max(id) FROM pages) + row_number() OVER (ORDER BY seq, url), true FROM f WHERE url NOT IN (SELECT url FROM o)""",
)
def get_or_create_page(spark, where):
    found = items(spark, where).select("url", (F.col("ms") * 1000 + F.col("seq")).alias("seq"))
    return crawl.get_or_create_pages(table(spark, where, "pages").select("id", "url"), found)


@query(
    "ensure_domain",
    f"""WITH {NUM_PAGES}, h AS (SELECT DISTINCT {HOST.format('url')} AS domain FROM cur) SELECT domain, crawl_delay_sec, disallow_all FROM (SELECT DISTINCT * FROM domains)
    UNION ALL SELECT domain, 3.0, false FROM h WHERE domain IS NOT NULL AND domain NOT IN (SELECT domain FROM domains)""",
)
def ensure_domain(spark, where):
    hosts = pages(spark, where, "url").select(host_of("url").alias("domain"))
    return crawl.ensure_domains(table(spark, where, "domains").distinct(), hosts).select("domain", "crawl_delay_sec", "disallow_all")


ROBOTS = """rb AS (SELECT domain, max(robots_txt) AS txt FROM domains WHERE domain IS NOT NULL GROUP BY 1),
    rules AS (SELECT domain, txt AS robots_txt, greatest(coalesce(try_cast(regexp_extract(txt, '(?im)^crawl-delay: *([0-9]+) *$', 1) AS DOUBLE), 3.0), 3.0) AS crawl_delay_sec,
        txt IS NULL AND length(domain) % 2 = 0 AS disallow_all FROM rb)"""


def fetched_robots(spark, where):
    """A fetch of each domain's robots.txt: the stored text with status 200; without one 403 or 404, by the name's length."""
    known = table(spark, where, "domains").where(F.col("domain").isNotNull()).groupBy("domain").agg(F.max("robots_txt").alias("body"))
    status = F.when(F.col("body").isNotNull(), 200).when(F.length("domain") % 2 == 0, 403).otherwise(404)
    return crawl.robots_rules(known.withColumn("status", status), now())


@query("robots_rules", f"WITH {ROBOTS} SELECT domain, robots_txt, crawl_delay_sec, disallow_all FROM rules")
def robots_rules(spark, where):
    return fetched_robots(spark, where).select("domain", "robots_txt", "crawl_delay_sec", "disallow_all")


@query(
    "update_robots",
    f"""WITH {ROBOTS}, d AS (SELECT DISTINCT * FROM domains)
    SELECT coalesce(d.domain, n.domain) AS domain, CASE WHEN n.domain IS NULL THEN d.robots_txt ELSE n.robots_txt END AS robots_txt,
    CASE WHEN n.domain IS NULL THEN d.crawl_delay_sec ELSE n.crawl_delay_sec END AS crawl_delay_sec,
    CASE WHEN n.domain IS NULL THEN d.disallow_all ELSE n.disallow_all END AS disallow_all, n.domain IS NOT NULL AS fetched FROM d FULL JOIN rules n ON d.domain = n.domain""",
)
def update_robots(spark, where):
    """Domains after a fetch of robots.txt for each."""
    after = crawl.update_robots(table(spark, where, "domains").distinct(), fetched_robots(spark, where))
    return after.select("domain", "robots_txt", "crawl_delay_sec", "disallow_all", F.col("robots_fetched_at").eqNullSafe(now()).alias("fetched"))


@query(
    "conditional_headers",
    f"WITH {NUM_PAGES}, {ITEMS}, u AS (SELECT DISTINCT key AS url FROM k WHERE key IS NOT NULL) SELECT u.url, etag, last_modified FROM u LEFT JOIN cur ON cur.url = u.url",
)
def conditional_headers(spark, where):
    return crawl.conditional_headers(pages(spark, where, "url", "etag", "last_modified"), items(spark, where).where(F.col("url").isNotNull()))


@query(
    "insert_links",
    f"""WITH {NUM_PAGES}, {ITEMS}, f AS (SELECT parent_id AS src_page_id, key AS dst_url, entry_id, row_number() OVER (PARTITION BY parent_id, key ORDER BY ms * 1000 + seq, entry_id) AS r FROM k WHERE key IS NOT NULL AND parent_id IS NOT NULL)
    SELECT src_page_id, dst_url, cur.id AS dst_page_id, entry_id AS anchor_text FROM f LEFT JOIN cur ON cur.url = dst_url
    WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM links l WHERE l.src_page_id = f.src_page_id AND l.dst_url = f.dst_url)""",
)
def insert_links(spark, where):
    """Links found by the frontier's entries, whose ids stand for the anchors' texts."""
    found = items(spark, where).where(F.col("url").isNotNull() & F.col("parent_id").isNotNull()).select(
        F.col("parent_id").alias("src_page_id"), F.col("url").alias("dst_url"), F.col("entry_id").alias("anchor_text"), (F.col("ms") * 1000 + F.col("seq")).alias("pos")
    )
    return crawl.insert_links(table(spark, where, "links").select("src_page_id", "dst_url"), pages(spark, where, "url"), found)


@query(
    "page_cap",
    f"WITH {NUM_PAGES}, {ITEMS}, c AS (SELECT count(*) AS n FROM cur WHERE status IN ('crawled', 'not_modified')) SELECT entry_id FROM k JOIN cur p ON p.id = parent_id, c WHERE key IS NOT NULL AND p.depth < 2 AND {HOST.format('key')} = {HOST.format('p.url')} AND c.n < 2000",
)
def page_cap(spark, where):
    """Entries to follow while fewer than 2000 pages are fetched."""
    p = pages(spark, where, "url", "depth", "status")
    return crawl.expandable(items(spark, where), p, CrawlOptions(max_pages=2000), crawl.fetched_page_count(p)).select("entry_id")


@query("mark_in_progress", f"WITH {NUM_PAGES}, d AS (SELECT id FROM cur WHERE status = 'pending' AND next_retry_at <= TIMESTAMPTZ '{NOW}+00' ORDER BY next_retry_at, id LIMIT 50) SELECT id, CASE WHEN id IN (SELECT id FROM d) THEN 'in_progress' ELSE status END AS status FROM cur")
def mark_in_progress(spark, where):
    p = pages(spark, where, "status", "next_retry_at")
    return crawl.mark_in_progress(p, crawl.due_for_retry(p, now())).select("id", "status")


@query(
    "content_types",
    f"""WITH {NUM_PAGES}, t AS (SELECT id, ['text/html; charset=utf-8', 'application/xhtml+xml', 'application/pdf', 'TEXT/HTML', NULL, ''][id % 6 + 1] AS kind FROM cur)
    SELECT id, coalesce(lower(kind) LIKE '%text/html%' OR lower(kind) LIKE '%xhtml%', false) AS html FROM t""",
)
def content_types(spark, where):
    """A content type by page id, and whether it is html."""
    kinds = F.array(*[F.lit(k) for k in ("text/html; charset=utf-8", "application/xhtml+xml", "application/pdf", "TEXT/HTML")], F.lit(None).cast("string"), F.lit(""))
    return pages(spark, where, "depth").select("id", crawl.is_html(F.element_at(kinds, (F.col("id") % 6 + 1).cast("int"))).alias("html"))


@query(
    "bloom_membership",
    f"WITH {ITEMS} SELECT count(*) AS asked, count(*) FILTER (u.key IN (SELECT url FROM pages)) AS known, 0 AS missed, true AS few_wrong FROM (SELECT DISTINCT key FROM k WHERE key IS NOT NULL) u",
)
def bloom_membership(spark, where):
    """Every frontier url against a filter of the pages' urls: none of pages may be denied, and no more than 2 % of the others claimed."""
    from corvane.functions import bloom

    known = table(spark, where, "pages").select("url").where(F.col("url").isNotNull()).distinct()
    asked = items(spark, where).select("url")
    told = bloom.might_contain(asked, "url", bloom.set_bits(known, "url")).join(known.withColumn("known", F.lit(True)), "url", "left")
    return told.agg(
        F.count("*").alias("asked"), F.count_if("known").alias("known"), F.count_if(F.col("known") & ~F.col("maybe")).alias("missed"),
        (F.count_if(F.col("known").isNull() & F.col("maybe")) <= F.greatest(F.lit(3), 0.02 * F.count("*"))).alias("few_wrong"),
    )


@query("fetched_page_count", f"WITH {NUM_PAGES} SELECT count(*) AS fetched FROM cur WHERE status IN ('crawled', 'not_modified')")
def fetched_page_count(spark, where):
    return crawl.fetched_page_count(pages(spark, where, "status"))


@query(
    "recrawl_due",
    f"WITH {NUM_PAGES} SELECT id FROM cur WHERE status IN ('crawled', 'not_modified') AND next_crawl_at <= TIMESTAMPTZ '{NOW}+00' ORDER BY next_crawl_at, id LIMIT 50",
)
def recrawl_due(spark, where):
    return crawl.due_for_recrawl(pages(spark, where, "status", "next_crawl_at"), now()).select("id")


@query(
    "retry_due",
    f"WITH {NUM_PAGES} SELECT id FROM cur WHERE status = 'pending' AND next_retry_at <= TIMESTAMPTZ '{NOW}+00' ORDER BY next_retry_at, id LIMIT 50",
)
def retry_due(spark, where):
    return crawl.due_for_retry(pages(spark, where, "status", "next_retry_at"), now()).select("id")


@query(
    "recrawl_claim",
    f"""WITH {NUM_PAGES}, d AS (SELECT id FROM cur WHERE status IN ('crawled', 'not_modified') AND next_crawl_at <= TIMESTAMPTZ '{NOW}+00' ORDER BY next_crawl_at, id LIMIT 50)
    SELECT id, next_crawl_at IS NOT NULL AND id NOT IN (SELECT id FROM d) AS waiting FROM cur""",
)
def recrawl_claim(spark, where):
    p = pages(spark, where, "status", "next_crawl_at")
    return crawl.claim(p, crawl.due_for_recrawl(p, now()), "next_crawl_at").select("id", F.col("next_crawl_at").isNotNull().alias("waiting"))


@query(
    "retry_outcome",
    f"""WITH {NUM_PAGES}, c AS (SELECT id, coalesce(retry_count, 0) + 1 AS n FROM cur)
    SELECT id, CASE WHEN n > 3 THEN 'failed' ELSE 'retry_scheduled' END AS outcome, CASE WHEN n <= 3 THEN least(5.0 * pow(2.0, n - 1), 300.0) END AS delay FROM c""",
)
def retry_outcome(spark, where):
    p = pages(spark, where, "retry_count").select("id", crawl.retry_outcome(F.coalesce("retry_count", F.lit(0)) + 1).alias("r"))
    return p.select("id", F.col("r.outcome").alias("outcome"), F.col("r.delay").alias("delay"))


RESULT_KIND = "CASE id % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'not_modified' WHEN 2 THEN 'failure' WHEN 3 THEN 'permanent' ELSE 'skipped' END"


COPIED = ("title", "content_hash", "etag", "last_modified", "minio_key")
_MICROS = "epoch_us({0}) - epoch_us(TIMESTAMPTZ '" + NOW + "+00')"


@query(
    "page_status_fold",
    f"""WITH {NUM_PAGES}, r AS (SELECT *, {RESULT_KIND} AS kind, coalesce(retry_count, 0) + 1 AS n FROM cur)
    SELECT id, CASE kind WHEN 'success' THEN 'crawled' WHEN 'not_modified' THEN 'not_modified' WHEN 'failure' THEN CASE WHEN n > 3 THEN 'failed' ELSE 'pending' END
        WHEN 'permanent' THEN 'failed' ELSE 'skipped' END AS status, CASE WHEN kind = 'failure' THEN n ELSE retry_count END AS retry_count,
    CASE WHEN kind <> 'skipped' THEN 200 + id % 7 ELSE http_status END AS http_status,
    {", ".join(f"CASE WHEN kind = 'success' THEN 'new {c} ' || id ELSE {c} END AS {c}" for c in COPIED)},
    CASE WHEN kind = 'success' THEN id % 1000 ELSE content_length END AS content_length,
    CASE WHEN kind = 'success' AND first_crawled_at IS NULL THEN 0 ELSE {_MICROS.format("first_crawled_at")} END AS first_crawled,
    CASE WHEN kind <> 'skipped' THEN 0 ELSE {_MICROS.format("last_crawled_at")} END AS last_crawled,
    CASE WHEN kind IN ('success', 'not_modified') THEN 86400000000 WHEN kind = 'skipped' THEN {_MICROS.format("next_crawl_at")} END AS next_crawl,
    CASE WHEN kind = 'failure' AND n <= 3 THEN (least(5.0 * pow(2.0, n - 1), 300.0) * 1000000)::BIGINT END AS wait,
    CASE WHEN kind IN ('success', 'not_modified') THEN NULL ELSE substr(repeat('x', 2500), 1, 2000) END AS error FROM r""",
)
def page_status_fold(spark, where):
    """One batch of results, whose kinds and values follow from the ids, applied to all pages; times in microseconds from now."""
    p = pages(spark, where, *[c for c in table(spark, where, "pages").columns if c != "id"])
    kind = F.element_at(F.array(*[F.lit(k) for k in ("success", "not_modified", "failure", "permanent", "skipped")]), (F.col("id") % 5 + 1).cast("int"))
    results = p.select(
        "id", kind.alias("kind"), (200 + F.col("id") % 7).cast("int").alias("http_status"), *[F.concat(F.lit(f"new {c} "), "id").alias(c) for c in COPIED],
        (F.col("id") % 1000).cast("int").alias("content_length"), F.repeat(F.lit("x"), F.lit(2500)).alias("error"),
    )
    after = crawl.apply_results(p, results, now())
    since = lambda c: F.unix_micros(c) - F.unix_micros(now())
    times = {"first_crawled": "first_crawled_at", "last_crawled": "last_crawled_at", "next_crawl": "next_crawl_at", "wait": "next_retry_at"}
    return after.select(
        "id", "status", "retry_count", "http_status", *COPIED, "content_length", *[since(c).alias(n) for n, c in times.items()], "error"
    )


@query(
    "fetch_outcomes",
    f"""WITH {NUM_PAGES}, o AS (SELECT CASE WHEN http_status = 304 OR status = 'not_modified' THEN 'not_modified' WHEN http_status = 200 AND error IS NULL THEN 'success'
        WHEN coalesce(http_status, 0) = 0 THEN 'error' WHEN http_status = 200 THEN 'non_html_retry' ELSE 'http_' || http_status END AS outcome FROM cur)
    SELECT outcome, count(*) AS total FROM o GROUP BY 1""",
)
def fetch_outcomes(spark, where):
    p = pages(spark, where, "http_status", "status", "error")
    outcome = crawl.fetch_outcome(F.col("http_status"), F.coalesce(F.col("status") == "not_modified", F.lit(False)), F.col("error"))
    return p.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("total"))


@query(
    "crawl_delay",
    "SELECT DISTINCT domain, greatest(coalesce(crawl_delay_sec, 3.0), 3.0) AS delay, greatest(1, floor(greatest(coalesce(crawl_delay_sec, 3.0), 3.0) * 1000))::BIGINT AS ttl_ms FROM domains",
)
def crawl_delay(spark, where):
    d = table(spark, where, "domains").distinct().withColumn("delay", crawl.crawl_delay(F.col("crawl_delay_sec")))
    return d.select("domain", "delay", crawl.limiter_ttl_ms(F.col("delay")).alias("ttl_ms"))


@query(
    "rate_limit_accept",
    f"""WITH RECURSIVE {ITEMS}, d AS (SELECT domain, max(greatest(coalesce(crawl_delay_sec, 3.0), 3.0)) * 1000000 AS wait FROM domains GROUP BY 1),
    i AS MATERIALIZED (SELECT entry_id, k.domain, ms, wait, row_number() OVER (PARTITION BY k.domain ORDER BY ms, entry_id) AS n FROM k JOIN d USING (domain)),
    w(entry_id, domain, n, last, accepted) AS (SELECT entry_id, domain, n, ms, true FROM i WHERE n = 1 UNION ALL
        SELECT i.entry_id, i.domain, i.n, CASE WHEN i.ms >= w.last + i.wait THEN i.ms ELSE w.last END, i.ms >= w.last + i.wait FROM w JOIN i ON i.domain = w.domain AND i.n = w.n + 1)
    SELECT entry_id, accepted FROM w""",
)
def rate_limit_accept(spark, where):
    """Frontier entries against a limit of a thousand delays per domain, as entries lie minutes apart."""
    delays = table(spark, where, "domains").groupBy("domain").agg(F.max(crawl.crawl_delay(F.col("crawl_delay_sec"))).alias("delay"))
    joined = items(spark, where).join(delays, "domain").select("entry_id", "domain", "ms", (F.col("delay") * 1_000_000).cast("long").alias("wait"))
    return crawl.accept_by_rate(joined, "domain", "ms", "wait", "entry_id").select("entry_id", "accepted")


@query(
    "frontier_claim",
    f"""WITH {ITEMS}, d AS (SELECT *, ms % 7 < 5 AS delivered, ms % 7 < 3 AS acked FROM k), idle AS (SELECT entry_id, ms, seq FROM d WHERE delivered AND NOT acked AND ms + 300000 <= 1746200000000)
    SELECT entry_id FROM (SELECT entry_id, ms, seq FROM idle UNION ALL SELECT entry_id, ms, seq FROM d WHERE NOT delivered AND NOT EXISTS (SELECT 1 FROM idle)) ORDER BY ms, seq LIMIT 20""",
)
def frontier_claim(spark, where):
    """Deliveries and acknowledgements derived from the entry times: the next twenty entries for a consumer."""
    entries = items(spark, where)
    delivered = entries.where(F.col("ms") % 7 < 5).select("entry_id", F.col("ms").alias("claimed_ms"), (F.col("ms") % 7 < 3).alias("acked"))
    return crawl.claim_entries(entries.select("entry_id", "ms", "seq"), delivered, 1746200000000, CrawlOptions.visibility_timeout_ms, 20).select("entry_id")


@query(
    "robots_allow",
    f"""WITH u AS (SELECT DISTINCT url, {HOST.format('url')} AS domain, regexp_replace(url, '^[a-z]+://[^/?#]*', '') AS path FROM pages WHERE url IS NOT NULL),
    d AS (SELECT domain, max(robots_txt) AS txt, max(disallow_all) AS never FROM domains GROUP BY 1),
    r AS (SELECT domain, trim(substr(line, 10)) AS prefix FROM (SELECT domain, unnest(string_split(txt, chr(10))) AS line FROM d) WHERE line LIKE 'Disallow:%' AND length(trim(substr(line, 10))) > 0)
    SELECT url, u.domain, NOT coalesce(never, false) AND NOT EXISTS (SELECT 1 FROM r WHERE r.domain = u.domain AND starts_with(path, prefix)) AS allowed
    FROM u LEFT JOIN d ON d.domain = u.domain WHERE u.domain <> ''""",
)
def robots_allow(spark, where):
    return crawl.robots_allow(table(spark, where, "pages").select("url"), table(spark, where, "domains"))


# Ranges of addresses that are private, loopback, link-local, multicast, reserved or unspecified.
FORBIDDEN = """0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15
198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4""".split()


def _forbidden_sql(number: str) -> str:
    out = []
    for net in FORBIDDEN:
        base, bits = net.split("/")
        a, b, c, d = map(int, base.split("."))
        first = ((a * 256 + b) * 256 + c) * 256 + d
        out.append(f"{number} BETWEEN {first} AND {first + (1 << (32 - int(bits))) - 1}")
    return " OR ".join(out)


@query(
    "ssrf_check",
    f"""WITH {NUM_PAGES}, p AS (SELECT id, id * 2654435761 % 4294967296 AS n FROM cur)
    SELECT id, (n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) AS ip, {_forbidden_sql("n")} AS disallowed FROM p""",
)
def ssrf_check(spark, where):
    """An address made from each page id, and whether it is forbidden."""
    p = pages(spark, where, "depth").withColumn("n", F.col("id") * 2654435761 % 4294967296)
    ip = F.concat_ws(".", *[(F.floor(F.col("n") / 256**k) % 256).cast("string") for k in (3, 2, 1, 0)])
    return p.select("id", ip.alias("ip"), disallowed_address(ip).alias("disallowed"))
