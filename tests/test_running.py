"""Running aggregates of hot keys against a plain loop."""

import random

from ledgerline.operators.running import running_stats

MEASURES = {"n": ("count", "v"), "total": ("sum", "v"), "top": ("max", "v"), "least": ("min", "v")}


def plain(rows):
    out = []
    place = lambda at: -1 if at is None else at
    for key, at, no, value in rows:
        seen = [v for k, a, _, v in rows if k == key and place(a) <= place(at) and v is not None]
        out.append((key, at, no, value, len(seen), sum(seen) if seen else None, max(seen, default=None),
                    min(seen, default=None)))
    return sorted(out, key=lambda r: r[2])


def check(spark, rows, hot_rows):
    frame = spark.createDataFrame(rows, "k string, at long, no long, v long")
    found = running_stats(frame, key=["k"], order=["at"], measures=MEASURES, hot_rows=hot_rows).collect()
    assert sorted((tuple(r) for r in found), key=lambda r: r[2]) == plain(rows)


def test_hot_keys_ties_and_nulls(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.choice([None, *range(40)]), no,
             draw.choice([None, draw.randint(-9, 9)])) for no in range(300)]
    for hot_rows in (1_000, 120, 20, 3):
        check(spark, rows, hot_rows)


def test_one_key_spreads_over_slots(spark):
    frame = spark.range(4_000).selectExpr("concat('k', id - id) AS k", "id AS at", "if(id < 0, null, id) AS v")
    found = running_stats(frame, key=["k"], order=["at"], measures={"n": ("count", "v")}, hot_rows=200)
    assert found.columns == ["k", "at", "v", "n"]
    assert found.where("n != at + 1").count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # The part for ordinary keys is empty here; the hot part knows no window over the key alone.
    hot = plan[plan.index("_of_running_slot"):]
    assert "windowspecdefinition(k#" in hot and all(
        "_running_slot#" in line for line in hot.splitlines() if "windowspecdefinition(k#" in line)


def test_empty(spark):
    frame = spark.createDataFrame([], "k string, at long, no long, v long")
    assert running_stats(frame, key=["k"], order=["at"], measures=MEASURES).collect() == []


def test_sales_up_to_each_change_with_a_hot_inventory(spark):
    """A third of everything lies in one inventory, which then takes several tasks."""
    from ledgerline.operators.rules import RapidConsecutiveSales, RuleContext
    from pyspark.sql import functions as F

    draw = random.Random(8)
    at = lambda n: f"2024-01-01 00:{n // 60:02d}:{n % 60:02d}"
    sold = [(draw.choice(["hot", "b", "c"]), n, at(n), draw.randint(1, 9)) for n in range(0, 240, 2)]
    asked = [(draw.choice(["hot", "b", "c"]), n, f"E{n}") for n in range(1, 240, 2)]
    sales = spark.createDataFrame(sold, "inventory_id string, sequence long, at string, quantity_sold long").withColumn(
        "sold_at", F.to_timestamp("at"))
    changes = spark.createDataFrame(asked, "inventory_id string, sequence long, event_id string")
    as_of = F.to_timestamp(F.lit(at(100)))
    expected = {}
    for inventory, n, event in asked:
        seen = [q for i, m, _, q in sold if i == inventory and m <= n and m >= 100 - 60]
        if len(seen) >= 5:
            expected[event] = f"{len(seen)} {sum(seen)}"
    for hot_rows in (10**6, 20, 7):
        context = RuleContext(changes, sales, changes, as_of, hot_rows)
        found = RapidConsecutiveSales().after(changes, context)
        assert {r.event_id: f"{r.window_count} {r.window_sum}" for r in found.collect()} == expected
