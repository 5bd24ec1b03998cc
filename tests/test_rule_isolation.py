"""A rule that fails while it runs must not stop the others."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import rules


class DividesByZero:
    def evaluate(self, context):
        return context.inventory.select(
            F.col("id").alias("inventory_id"), F.lit("odd").alias("anomaly_type"), F.lit("low").alias("severity"),
            (F.lit(1) / (F.col("quantity") - F.col("quantity"))).cast("double").alias("score"), F.lit("x").alias("description"))


@pytest.fixture
def context(spark):
    inventory = spark.createDataFrame([("i1", "P1", "W", -3), ("i2", "P2", "W", 4)],
                                      "id string, sku string, warehouse_id string, quantity int")
    sold = [("i2", 1, f"2024-01-01 00:00:{n:02d}", n) for n in range(6)]
    sales = spark.createDataFrame(sold, "inventory_id string, quantity_sold int, at string, sequence long").withColumn(
        "sold_at", F.to_timestamp("at"))
    history = spark.createDataFrame([("h", "i2", 9, 0, 9, "E5", "2024-01-01 00:00:05", 5)],
                                    "id string, inventory_id string, quantity_delta int, quantity_before int, "
                                    "quantity_after int, source_event_id string, at string, sequence long").withColumn(
        "changed_at", F.to_timestamp("at"))
    return rules.RuleContext(inventory, sales, history, F.to_timestamp(F.lit("2024-01-01 00:00:10")))


def engine(isolate):
    found = [rules.NegativeInventoryRule(), DividesByZero(), rules.LargeInventoryAdjustment(), rules.RapidConsecutiveSales()]
    return rules.RuleEngine(found, isolate=isolate)


def test_a_rule_that_divides_by_zero_is_skipped(spark, context):
    isolated = engine(True)
    found = isolated.detect(context)
    assert {(r.inventory_id, r.rule_no) for r in found.collect()} == {("i1", 0), ("i2", 2), ("i2", 3)}
    failed = isolated.failures(spark).collect()
    assert [(r.rule_no, r.rule) for r in failed] == [(1, "DividesByZero")] and "DIVIDE_BY_ZERO" in failed[0].error
    after = isolated.detect_after(context.history, context)
    assert {(r.event_id, r.rule_no) for r in after.collect()} == {("E5", 2), ("E5", 3)}
    assert [r.rule_no for r in isolated.failures(spark).collect()] == [1]


def test_without_isolation_the_run_fails(context):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        engine(False).detect(context).collect()
