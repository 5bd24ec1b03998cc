import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.rules import one_decimal
from ledgerline.operators.trailing import trailing_stats


@pytest.mark.parametrize("lookback", [1, 7, 50, 400])
def test_hot_keys_equal_brute_force(spark, lookback):
    rng = random.Random(lookback)
    rows = [(i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.randrange(300) - 50,
             None if rng.random() < 0.1 else rng.randrange(100)) for i in range(250)]
    frame = spark.createDataFrame(rows, "id long, k string, t long, v long")
    plain = trailing_stats(frame, key=["k"], at="t", value="v", lookback_micros=lookback)
    slots = trailing_stats(frame, key=["k"], at="t", value="v", lookback_micros=lookback, hot_rows=20)
    assert plain.dtypes == slots.dtypes
    expected = {}
    for i, k, t, _ in rows:
        seen = [v for _, k2, t2, v in rows if k2 == k and t - lookback <= t2 <= t and v is not None]
        expected[i] = (len(seen), sum(seen) if seen else None, max(seen) if seen else None)
    for frame in (plain, slots):
        assert {r["id"]: (r["window_count"], r["window_sum"], r["window_max"]) for r in frame.collect()} == expected


def test_one_decimal_rounds_the_binary_value(spark):
    values = [0.05, 0.25, 0.35, 0.75, 2.45, 5.45, 1234.55, 12.25, 0.0, 99.95, 1 / 3] + [k / 20 for k in range(1, 400, 2)]
    frame = spark.createDataFrame([(v,) for v in values], "v double").select("v", one_decimal(F.col("v")).alias("s"))
    assert [(r["v"], r["s"]) for r in frame.collect()] == [(v, f"{v:.1f}") for v in values]


def test_bursts_grow_in_proportion(spark):
    """One key, a row a second, and thousands of rows at one instant within one window."""
    def burst(n):
        rows = spark.range(n).selectExpr("'k' AS k", "id * 1000000 AS t", "id % 97 AS v")
        return rows.unionByName(spark.range(3_000).selectExpr("'k' AS k", "5000000000 AS t", "id % 89 AS v"))

    lookback = 600 * 1_000_000
    found = trailing_stats(burst(10_000), key=["k"], at="t", value="v", lookback_micros=lookback, hot_rows=1_000)
    got = {r["t"]: (r["window_count"], r["window_sum"], r["window_max"]) for r in found.distinct().collect()}
    at_once = [i % 89 for i in range(3_000)]
    for second in (0, 600, 601, 4_999, 5_000, 5_001, 5_600, 5_601, 9_999):
        seen = [i % 97 for i in range(max(0, second - 600), second + 1)] + at_once * (second - 600 <= 5_000 <= second)
        assert got[second * 1_000_000] == (len(seen), sum(seen), max(seen))
    assert found.count() == 13_000
