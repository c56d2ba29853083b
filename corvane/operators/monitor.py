"""Time-series queries over events or metrics: rates, gauges, histograms and quantiles in sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Upper bounds of the fetch latency buckets, in seconds.
FETCH_BUCKETS = (0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0)


def rate(events: DataFrame, ts: str, by: str, width_sec: int = 60, slide_sec: int | None = None) -> DataFrame:
    """(window_start, by, rate): events per second in each window. Plain counts over the width, without extrapolation."""
    window = F.window(ts, f"{width_sec} seconds", f"{slide_sec or width_sec} seconds")
    out = events.groupBy(window.alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), by, (F.col("n") / width_sec).alias("rate"))


def gauge(samples: DataFrame, ts: str, by: str, value: str, width_sec: int = 60) -> DataFrame:
    """(window_start, by, value): the last sample of each window; of equal times the greater value."""
    last = F.max(F.struct(ts, value)).alias("l")
    out = samples.groupBy(F.window(ts, f"{width_sec} seconds").alias("w"), by).agg(last)
    return out.select(F.col("w.start").alias("window_start"), by, F.col(f"l.{value}").alias("value"))


def histogram(events: DataFrame, by: list[str | Column], value: str, bounds: tuple[float, ...] = FETCH_BUCKETS) -> DataFrame:
    """(by..., le, n): cumulative counts per upper bound, infinity last. Null values are in no bucket."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)] + [F.count(value).alias("all")]
    wide = events.groupBy(*by).agg(*counts)
    cells = [F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    names = [c for c in wide.columns if not c.startswith("b") or not c[1:].isdigit()]
    return wide.select(*[c for c in names if c != "all"], F.explode(F.array(*cells)).alias("c")).select(*[c for c in names if c != "all"], "c.le", "c.n")


def quantile(buckets: DataFrame, by: list[str], share: float) -> DataFrame:
    """(by..., value): linear interpolation within the first bucket that reaches the share; the last finite bound
    where that is the infinite one; null without events."""
    order = Window.partitionBy(*by).orderBy("le")
    whole = Window.partitionBy(*by)
    rows = buckets.select(
        *by, "le", "n", F.coalesce(F.lag("le").over(order), F.lit(0.0)).alias("lo"), F.coalesce(F.lag("n").over(order), F.lit(0)).alias("below"),
        F.max("n").over(whole).alias("total"),
    )
    target = F.col("total") * share
    found = rows.where((F.col("total") > 0) & (F.col("n") >= target) & ((F.col("below") < target) | (F.col("below") == 0)))
    inside = F.col("lo") + (F.col("le") - F.col("lo")) * (target - F.col("below")) / F.greatest(F.col("n") - F.col("below"), F.lit(1))
    value = F.when(F.col("le") == float("inf"), F.col("lo")).otherwise(inside)
    best = found.groupBy(*by).agg(F.min(F.struct("le", value.alias("v"))).alias("b"))
    return best.select(*by, F.col("b.v").alias("value"))


def counter(events: DataFrame, label: str | Column) -> DataFrame:
    return events.groupBy(label).agg(F.count("*").alias("total"))


def windowed_quantile(events: DataFrame, ts: str, by: str, value: str, share: float, width_sec: int = 300, bounds: tuple[float, ...] = FETCH_BUCKETS) -> DataFrame:
    """(window_start, by, value): the quantile of each window from its histogram; windows without events have no row."""
    timed = events.where(F.col(ts).isNotNull()).select(F.window(ts, f"{width_sec} seconds").start.alias("window_start"), by, value)
    return quantile(histogram(timed, ["window_start", by], value, bounds), ["window_start", by], share)


def exposition(samples: DataFrame, name: str, label: str, value: str) -> DataFrame:
    """(line) of the text form in which metrics are scraped; label values are escaped, samples without a value left out."""
    escaped = F.coalesce(F.col(label).cast("string"), F.lit(""))
    for sign, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(shown))
    known = samples.where(F.col(value).isNotNull())
    return known.select(F.concat(F.lit(f'{name}{{{label}="'), escaped, F.lit('"} '), F.col(value).cast("string")).alias("line"))
