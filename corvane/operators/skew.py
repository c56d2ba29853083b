"""Joins and per-key results where a few keys hold much of the data.

Heavy keys are those that hold at least a share of all rows, so that there are at most 1/share of them: a proven
bound, which is why they alone are broadcast. Everything else is shuffled after partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.session import settle

HEAVY_SHARE = 0.01
SALTS = 32
BUCKETS = 1024
MOST = 1.7976931348623157e308  # the greatest finite double


def heavy_keys(counts: DataFrame, key: str, rows: str, share: float = HEAVY_SHARE) -> DataFrame:
    """(key): keys whose `rows` make up at least `share` of the total, from one row per key. At most 1/share rows.

    Null keys are never heavy; they match nothing in a join. An empty table has no heavy keys.
    """
    total = counts.agg(F.sum(rows).alias("_total"))
    known = counts.where(F.col(key).isNotNull())
    return known.crossJoin(F.broadcast(total)).where(F.col(rows) >= share * F.col("_total")).select(key)


def salted_join(facts: DataFrame, lookup: DataFrame, key: str, heavy: DataFrame, how: str = "inner", salts: int = SALTS, narrow_facts: bool = False) -> DataFrame:
    """Joins facts with a lookup that has one row per key, heavy keys spread over `salts` tasks.

    Rows of heavy keys get a salt, and the lookup's rows of these keys one copy per salt: at most salts/share copies.
    All other rows have salt 0. Columns other than the key mustn't clash. Facts with a null key match nothing
    (inner: dropped, left: kept with nulls). Equal rows of facts stay as many as they were. With narrow_facts the facts
    are hashed, so that a lookup with wide rows isn't sorted.
    """
    mark = F.broadcast(heavy.select(key).withColumn("_heavy", F.lit(True)))
    salted = facts.join(mark, key, "left").withColumn(
        "_salt", F.when(F.col("_heavy"), (F.rand(7) * salts).cast("int")).otherwise(0)
    )
    copies = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = lookup.join(mark, key, "left").withColumn("_salt", F.explode(copies))
    left = salted.drop("_heavy")
    return (left.hint("shuffle_hash") if narrow_facts else left).join(spread.drop("_heavy"), [key, "_salt"], how).drop("_salt")


def compress(df: DataFrame, key: str, value: str, weight: str | None = None) -> DataFrame:
    """(key, value, freq, weight): one row per pair, so that what follows works on weighted values.

    Grouping by both columns spreads a heavy key over all tasks and is combined before the shuffle. Null keys and
    null values are groups of their own. Without a weight column the weight is 0.
    """
    total = F.sum(weight) if weight else F.lit(0)
    return df.groupBy(key, value).agg(F.count("*").alias("freq"), F.coalesce(total, F.lit(0)).alias("weight"))


def per_key(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_rows, n_values, weight, mode_value, mode_freq) from compressed pairs, exact.

    n_values counts values that aren't null; mode_value is the most frequent of these, of several the least. Both
    steps are combined before the shuffle, so a heavy key sends one row per task.
    """
    real = F.col(value).isNotNull()
    best = F.min(F.when(real, F.struct((-F.col("freq")).alias("f"), F.col(value).alias("v")))).alias("_best")
    out = pairs.groupBy(key).agg(
        F.sum("freq").alias("n_rows"), F.count(value).alias("n_values"), F.sum("weight").alias("weight"), best
    )
    return out.select(
        key, "n_rows", "n_values", "weight", F.col("_best.v").alias("mode_value"), (-F.col("_best.f")).alias("mode_freq")
    )


def percentiles(pairs: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """(key, share, value): the least value at or below which at least `share` of the key's rows lie, exact.

    Works on compressed pairs of numbers. The range that holds the wanted row is split into at most 1024 parts, whose
    sums are combined before the shuffle; running sums find the part that holds it, and this part, between the least
    and greatest value that it has, is the next range, until one value is left. The first split is even by order of
    magnitude, so that outliers don't leave all other values in one part. Nothing is ever sorted but a key's parts. Null
    values (and NaN) are left out; a key without any number has no rows. Infinite values are parts of their own.
    """
    number = F.col(value).cast("double")
    rows = settle(pairs.where(F.col(value).isNotNull() & ~F.isnan(number) & F.col(key).isNotNull()).select(key, value, "freq"))
    sizes = rows.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("freq").alias("_n"))
    heavy = settle(heavy_keys(sizes, key, "_n"))
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    state = sizes.select(key, "_lo", "_hi", "_n", wanted)
    state = settle(state.select(key, "share", "_lo", "_hi", F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("_n") - 1e-9)).cast("long").alias("_at")))
    finite = lambda c: F.abs(c) != F.lit(float("inf"))
    turn = 0
    while not state.where(F.col("_lo") != F.col("_hi")).isEmpty():
        scale = F.asinh if turn % 2 == 0 else (lambda c: c)
        open_ = state.where(F.col("_lo") != F.col("_hi")).groupBy(key).agg(F.collect_list(F.struct("share", "_lo", "_hi", "_at")).alias("_s"))
        each = salted_join(rows, open_, key, heavy).select(key, value, "freq", F.explode("_s").alias("_s"))
        each = each.where((F.col(value) >= F.col("_s._lo")) & (F.col(value) <= F.col("_s._hi")))
        x, lo, hi = number, F.col("_s._lo").cast("double"), F.col("_s._hi").cast("double")
        least, most = F.when(finite(lo), lo).otherwise(-MOST), F.when(finite(hi), hi).otherwise(MOST)
        width = scale(most) / BUCKETS - scale(least) / BUCKETS
        place = F.when(~finite(x), F.when(x < 0, F.lit(-1)).otherwise(BUCKETS + 1)).when(width > 0, F.greatest(F.lit(0), F.least(F.floor(scale(x) / width - scale(least) / width), F.lit(BUCKETS)))).otherwise(0)
        parts = each.groupBy(key, F.col("_s.share").alias("share"), place.cast("int").alias("_b")).agg(
            F.sum("freq").alias("_f"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.first("_s._at").alias("_at")
        )
        running = Window.partitionBy(key, "share").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        held = parts.withColumn("_to", F.sum("_f").over(running)).where((F.col("_at") <= F.col("_to")) & (F.col("_at") > F.col("_to") - F.col("_f")))
        found = held.select(key, "share", "_lo", "_hi", (F.col("_at") - (F.col("_to") - F.col("_f"))).alias("_at"))
        state = settle(state.where(F.col("_lo") == F.col("_hi")).unionByName(found))
        turn += 1
    return state.select(key, "share", F.col("_lo").alias("value"))


def named_heavy(per_key_rows: DataFrame, key: str, size: str, share: float, field: str) -> DataFrame:
    """(field, key_value) of the keys that hold at least `share` of all; an exact fraction test on whole numbers."""
    parts = round(share * 1_000_000)
    total = per_key_rows.agg(F.sum(size).alias("_total"))
    return (
        per_key_rows.where(F.col(key).isNotNull())
        .crossJoin(F.broadcast(total))
        .where(F.col(size) * 1_000_000 >= F.col("_total") * parts)
        .select(F.lit(field).alias("field"), F.lower(key).alias("key_value"))
    )
