"""Monitoring queries: events stand for fetch attempts, event_type for the outcome, value for the duration."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import monitor
from corvane.plans.registry import query
from corvane.sources.tables import table


def events(spark, where):
    return table(spark, where, "events")


def buckets_sql(by: str) -> str:
    cells = ", ".join(f"({b}::DOUBLE)" for b in monitor.FETCH_BUCKETS)
    return f"""les(le) AS (VALUES {cells}, ('infinity'::DOUBLE)), h AS (SELECT {by} AS g, le, count(*) FILTER (value <= le) AS n FROM events, les GROUP BY 1, 2)"""


@query("metrics_rate", "SELECT time_bucket(INTERVAL 60 SECOND, ts) AS window_start, event_type, count(*) / 60.0::DOUBLE AS rate FROM events GROUP BY 1, 2")
def metrics_rate(spark, where):
    return monitor.rate(events(spark, where), "ts", "event_type")


@query(
    "metrics_rate_sliding",
    """WITH s AS (SELECT event_type, unnest(generate_series(0, 55, 5)) AS back, ts FROM events)
    SELECT time_bucket(INTERVAL 5 SECOND, ts) - to_seconds(back) AS window_start, event_type, count(*) / 60.0::DOUBLE AS rate FROM s GROUP BY 1, 2""",
)
def metrics_rate_sliding(spark, where):
    return monitor.rate(events(spark, where), "ts", "event_type", 60, 5)


@query(
    "metrics_gauge",
    "SELECT time_bucket(INTERVAL 3600 SECOND, ts) AS window_start, event_type, max_by(value, struct_pack(t := ts, v := value)) AS value FROM events GROUP BY 1, 2",
)
def metrics_gauge(spark, where):
    return monitor.gauge(events(spark, where), "ts", "event_type", "value", 3600)


@query("metrics_histogram", f"WITH {buckets_sql('event_type')} SELECT g AS event_type, le, n FROM h")
def metrics_histogram(spark, where):
    return monitor.histogram(events(spark, where), ["event_type"], "value")


@query(
    "metrics_quantile",
    f"""WITH {buckets_sql('event_type')}, r AS (SELECT g, le, n, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY g) AS total FROM h WINDOW w AS (PARTITION BY g ORDER BY le)),
    f AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY le) AS k FROM r WHERE n >= 0.95 * total AND total > 0)
    SELECT g AS event_type, CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (0.95 * total - below) / greatest(n - below, 1) END AS value FROM f WHERE k = 1""",
)
def metrics_quantile(spark, where):
    return monitor.quantile(monitor.histogram(events(spark, where), ["event_type"], "value"), ["event_type"], 0.95)


def _quantile_5m_sql(share: float) -> str:
    cells = ", ".join(f"({b}::DOUBLE)" for b in monitor.FETCH_BUCKETS)
    return f"""WITH les(le) AS (VALUES {cells}, ('infinity'::DOUBLE)),
    h AS (SELECT time_bucket(INTERVAL 300 SECOND, ts) AS window_start, event_type, le, count(*) FILTER (value <= le) AS n FROM events, les GROUP BY 1, 2, 3),
    r AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY window_start, event_type) AS total FROM h WINDOW w AS (PARTITION BY window_start, event_type ORDER BY le)),
    f AS (SELECT *, row_number() OVER (PARTITION BY window_start, event_type ORDER BY le) AS k FROM r WHERE n >= {share} * total AND total > 0)
    SELECT window_start, event_type, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * ({share} * total - below) / greatest(n - below, 1) END, 9) AS value FROM f WHERE k = 1"""


def _quantile_5m(spark, where, share):
    return monitor.windowed_quantile(events(spark, where), "ts", "event_type", "value", share).withColumn("value", F.round("value", 9))


@query("metrics_p50_5m", _quantile_5m_sql(0.5))
def metrics_p50_5m(spark, where):
    return _quantile_5m(spark, where, 0.5)


@query("metrics_p95_5m", _quantile_5m_sql(0.95))
def metrics_p95_5m(spark, where):
    return _quantile_5m(spark, where, 0.95)


@query("metrics_exposition", """SELECT 'events_total{event_type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""")
def metrics_exposition(spark, where):
    return monitor.exposition(monitor.counter(events(spark, where), "event_type"), "events_total", "event_type", "total")


@query("metrics_counters", "SELECT event_type, count(*) AS total FROM events GROUP BY 1")
def metrics_counters(spark, where):
    return monitor.counter(events(spark, where), "event_type")


@query(
    "stat_panels",
    "SELECT count(*) FILTER (event_type <> 'error') AS pages_total, count(DISTINCT user_id) AS sessions, round(sum(value), 2) AS value_total, max(value) AS value_peak FROM events",
)
def stat_panels(spark, where):
    return events(spark, where).agg(
        F.count_if(F.col("event_type") != "error").alias("pages_total"), F.countDistinct("user_id").alias("sessions"),
        F.round(F.sum("value"), 2).alias("value_total"), F.max("value").alias("value_peak"),
    )
