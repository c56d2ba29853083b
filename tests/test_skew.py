import math
import random
from collections import Counter

from pyspark.sql import functions as F

from corvane.operators import skew


def frame(spark, n=4000, seed=1):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(60)}", float(rng.choice([1, 2, 2, 3, 50, 1e6, -5.5]) if rng.random() < 0.9 else rng.random())) for _ in range(n)]
    rows += [(None, 1.0), ("nulls", None), ("nulls", float("nan")), ("inf", float("inf")), ("inf", float("-inf")), ("inf", 0.0)]
    return rows, spark.createDataFrame(rows, "k string, v double")


def test_per_key(spark):
    rows, df = frame(spark)
    got = {r.k: r for r in skew.per_key(skew.compress(df, "k", "v"), "k", "v").collect()}
    for key in {k for k, _ in rows}:
        own = Counter(v for k, v in rows if k == key and v is not None and not math.isnan(v))
        assert got[key].n_rows == sum(1 for k, _ in rows if k == key)
        if own and key not in ("nulls",):
            best = max(own.values())
            assert got[key].n_values == len(own) and got[key].mode_value == min(v for v, n in own.items() if n == best) and got[key].mode_freq == best


def test_percentiles(spark):
    rows, df = frame(spark)
    shares = [0.01, 0.5, 0.95, 1.0]
    got = {(r.k, r.share): r.value for r in skew.percentiles(skew.compress(df, "k", "v"), "k", "v", shares).collect()}
    keys = {k for k, v in rows if k is not None and v is not None and not math.isnan(v)}
    for key in keys:
        own = sorted(v for k, v in rows if k == key and v is not None and not math.isnan(v))
        for s in shares:
            assert got[key, s] == own[max(1, math.ceil(s * len(own) - 1e-9)) - 1], (key, s)
    assert len(got) == len(keys) * len(shares)


def test_salted_join_keeps_rows(spark):
    _, df = frame(spark)
    facts = df.withColumn("id", F.monotonically_increasing_id())
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3)], "k string, w int")
    heavy = skew.heavy_keys(facts.groupBy("k").agg(F.count("*").alias("n")), "k", "n")
    assert heavy.count() <= 100 and heavy.where("k = 'hot'").count() == 1
    want = facts.join(lookup, "k", "left").select("id", "k", "w")
    got = skew.salted_join(facts, lookup, "k", heavy, "left").select("id", "k", "w")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert skew.salted_join(facts, lookup, "k", heavy).count() == facts.where("k in ('hot', 'k1')").count()


def test_empty_and_named(spark):
    _, df = frame(spark)
    none = df.limit(0)
    assert skew.per_key(skew.compress(none, "k", "v"), "k", "v").count() == 0
    assert skew.percentiles(skew.compress(none, "k", "v"), "k", "v", [0.5]).count() == 0
    counts = skew.per_key(skew.compress(df, "k", "v"), "k", "v")
    named = skew.named_heavy(counts, "k", "n_rows", 0.3, "f").collect()
    assert [(r.field, r.key_value) for r in named] == [("f", "hot")]
    exact = spark.createDataFrame([("a", 25), ("b", 975)], "k string, n int")
    assert skew.named_heavy(exact, "k", "n", 0.025, "f").count() == 2


def test_percentiles_among_outliers(spark):
    """Values that a single even split leaves together, extremes of doubles, and infinite ones."""
    rng = random.Random(3)
    values = [rng.random() * 10 ** rng.randrange(-9, 9) for _ in range(3000)] + [1e300, -1e300, 5e-324, float("inf"), -float("inf"), 0.0]
    rows = [("a", v, rng.randrange(1, 4)) for v in values] + [("b", v, 1) for v in values[:50]] + [("c", 7.0, 5), ("d", None, 1), ("d", float("nan"), 2)]
    df = spark.createDataFrame(rows, "k string, v double, freq long")
    shares = [0.0, 0.01, 0.5, 0.95, 1.0]
    got = {(r.k, r.share): r.value for r in skew.percentiles(df, "k", "v", shares).collect()}
    for k in "abc":
        ordered = sorted(v for who, v, f in rows if who == k for _ in range(f))
        for s in shares:
            assert got[k, s] == ordered[max(1, math.ceil(s * len(ordered) - 1e-9)) - 1], (k, s)
    assert len(got) == 15
