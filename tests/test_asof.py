"""As-of join and sketches against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from innings.operators import sketches as Sk
from innings.operators.asof import asof_join


@pytest.mark.parametrize(("strict", "bits"), [(True, 2), (False, 2), (True, 12)])
def test_asof_join(spark, strict, bits):
    """A hot key over many slices, slices without versions, equal times, null keys, repeated rows."""
    rng = random.Random(bits)
    keys = ["hot"] * 6 + ["a", "b", None]
    left = [(rng.choice(keys), rng.randrange(120), i) for i in range(400)] + [("hot", 50, 1), ("hot", 50, 1), ("z", 3, 2)]
    right = [(rng.choice(keys), rng.choice([rng.randrange(20), rng.randrange(90, 110)]), rng.randrange(5), i) for i in range(80)]
    right += [("hot", 50, 9, 1000), ("hot", 50, 9, 999), ("a", None, 1, 1)]
    want = []
    for k, t, n in left:
        known = [(s, v, w) for x, s, v, w in right if x == k and k is not None and s is not None and (s < t or s == t and not strict)]
        want.append((k, t, n, *(max(known)[1:] if known else (None, None))))
    got = asof_join(spark.createDataFrame(left, "k string, t long, n int").repartition(4),
                    spark.createDataFrame(right, "k string, t long, v int, w int"), ["k"], "t", ["v", "w"], strict, bits)
    assert got.columns == ["k", "t", "n", "v", "w"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_sketches_of_days_merge(spark):
    rows = spark.range(60_000).select(
        F.timestamp_seconds(F.col("id") * 40).alias("ts"), (F.col("id") % 3).alias("g"),
        F.pmod(F.xxhash64("id"), F.lit(10_000)).cast("double").alias("v"), (F.col("id") % 7000).alias("u"))
    days = Sk.daily_sketches(rows, "ts", ["g"], "v", "u").cache()
    assert days.count() > 60
    for r in Sk.report(days, ["g"], [0.5, 0.95]).collect():
        assert r["n"] == 20_000 and abs(r["n_distinct"] - 7000) < 7000 * Sk.COUNT_ERROR
        assert abs(r["p50"] - 5000) < 250 and abs(r["p95"] - 9500) < 250
    assert Sk.report(days.limit(0), ["g"], [0.5]).count() == 0
