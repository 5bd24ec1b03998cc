"""Stock events, sales and reconciliation on small hand-made cases."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerline.functions.columns import inventory_id
from ledgerline.operators import balance, reconcile, sales
from ledgerline.sources.domain import inventory_table

T0 = datetime(2026, 7, 13, 10)
EVENT = "seq long, event_id string, product_id string, store_id string, operation string, quantity int"
SALE = ("seq long, event_id string, sale_id string, product_id string, store_id string, quantity_sold int, "
        "sale_price decimal(12,2), sold_at timestamp")


def stock_of(spark, quantity):
    return spark.createDataFrame([("P", "S", quantity)], "product_id string, store_id string, quantity long")


def post(spark, rows, quantity):
    from decimal import Decimal

    frame = spark.createDataFrame(
        [(i, f"E{i}", sale_id, "P", "S", n, None if price is None else Decimal(price), T0 + timedelta(minutes=i))
         for i, (sale_id, n, price) in enumerate(rows)], SALE)
    return sales.post_sales(frame, order=["seq"], balances=stock_of(spark, quantity))


def test_all_operations_and_audit_trail(spark):
    events = spark.createDataFrame([
        (0, "a", "P", "S", "RESTOCK", 10), (1, "b", "P", "S", "SALE", 3), (2, "c", "P", "S", "RETURN", 2),
        (3, "d", "P", "S", "MANUAL_ADJUSTMENT", -1), (4, "a", "P", "S", "RESTOCK", 10), (5, "e", "Q", "S", "SALE", 1)], EVENT)
    ledger = balance.apply_stock_events(events, order=["seq"])
    rows = balance.audit_rows(ledger, F.lit(T0)).orderBy("source_event_id").collect()
    assert [(r["quantity_after"], r["quantity_delta"], r["change_type"]) for r in rows] == [
        (10, 10, "restock"), (7, -3, "sale"), (9, 2, "return"), (8, -1, "adjustment")]
    assert [r["quantity_after"] for r in balance.duplicates(ledger).collect()] == [8]
    (refused,) = balance.refused(ledger).collect()
    assert refused["reason"] == "inventory quantity cannot be negative after applying event"
    # A key whose first event was refused does not come into being.
    assert [tuple(r) for r in balance.balances_after(ledger).collect()] == [("P", "S", 8)]


def test_rejected_id_may_succeed_later_elsewhere(spark):
    events = spark.createDataFrame([
        (0, "x", "A", "S", "SALE", 1), (1, "x", "B", "S", "RESTOCK", 1), (2, "x", "A", "S", "RESTOCK", 5)], EVENT)
    ledger = balance.apply_stock_events(events, order=["seq"])
    assert [r["status"] for r in ledger.orderBy("seq").collect()] == ["rejected", "applied", "duplicate"]


def test_processed_store_first_write_wins(spark):
    events = spark.createDataFrame([(1, "a", "P2", "S", "SALE", 1), (0, "a", "P1", "S", "SALE", 1),
                                    (2, "b", "P3", "S", "SALE", 1)], EVENT)
    stored = spark.createDataFrame([("b",)], "event_id string")
    (row,) = balance.processed_rows(events, order=["seq"], processed_at=F.lit(T0), processed=stored).collect()
    assert (row["event_id"], row["product_id"], row["status"]) == ("a", "P1", "processed")


def test_duplicate_sale_answers_with_the_original(spark):
    ledger = post(spark, [("X", 5, "2.50"), ("X", 99, None)], 20)
    (again,) = sales.duplicate_sales(ledger).collect()
    assert (again["original_quantity"], str(again["original_price"])) == (5, "2.50")
    assert [tuple(r) for r in balance.balances_after(ledger, stock_of(spark, 20)).collect()] == [("P", "S", 15)]


def test_sale_of_the_last_unit_and_shortage(spark):
    ledger = post(spark, [("X", 5, None), ("Y", 1, None)], 5)
    assert [r["status"] for r in ledger.orderBy("seq").collect()] == ["applied", "insufficient_stock"]
    (row,) = balance.refused(ledger).collect()
    assert row["reason"] == "insufficient stock: available=0, requested=1"


def summary(spark, rows):
    inventory = inventory_table(stock_of(spark, 100), F.lit(T0))
    posted = sales.sales_rows(post(spark, rows, 100), F.col("sold_at"))
    totals, items = sales.sales_of(inventory, posted, "P", "S")
    return totals.collect(), items.collect()


def test_summary_counts_all_and_prices_some(spark):
    (total,), items = summary(spark, [("A", 3, "10.00"), ("B", 2, "15.00"), ("C", 1, None)])
    assert (total["transaction_count"], total["total_quantity_sold"], str(total["total_revenue"])) == (3, 6, "60.00")
    assert [r["external_sale_id"] for r in items] == ["C", "B", "A"]


def test_summary_without_prices_or_sales(spark):
    (total,), _ = summary(spark, [("A", 3, None)])
    assert (total["transaction_count"], total["total_revenue"]) == (1, None)
    (total,), items = summary(spark, [])
    assert (total["transaction_count"], total["total_quantity_sold"], total["total_revenue"], items) == (0, 0, None, [])
    inventory = inventory_table(stock_of(spark, 100), F.lit(T0))
    posted = sales.sales_rows(post(spark, [], 1), F.col("sold_at"))
    assert sales.sales_of(inventory, posted, "unknown", "S")[0].collect() == []


def reconcile_one(spark, quantity, deltas):
    columns = "product_id string, store_id string, quantity long"
    inventory = inventory_table(spark.createDataFrame([] if quantity is None else [("P", "S", quantity)], columns), F.lit(T0))
    history = spark.createDataFrame([("P", "S", d) for d in deltas], "product_id string, store_id string, quantity_delta int")
    history = history.withColumn("inventory_id", inventory_id("store_id", "product_id"))
    return reconcile.reconcile(spark.createDataFrame([("P", "S")], "product_id string, store_id string"), inventory, history)


def test_reconciliation_states(spark):
    for quantity, deltas, expected in [
        (7, [10, -3], (7, 7, 0, "match")), (8, [10], (10, 8, -2, "mismatch")), (None, [4], (0, 0, 0, "missing")),
        (0, [], (0, 0, 0, "match")), (5, [], (0, 5, 5, "mismatch"))]:
        (row,) = reconcile_one(spark, quantity, deltas).collect()
        assert (row["expected_quantity"], row["actual_quantity"], row["difference"], row["status"]) == expected


def test_only_changes_are_stored(spark):
    from ledgerline.schemas import RECONCILIATION_RECORDS

    records = spark.createDataFrame([], RECONCILIATION_RECORDS)
    stored = []
    for hour, (quantity, deltas) in enumerate([(8, [10]), (8, [10]), (6, [10]), (10, [10])]):
        at = T0 + timedelta(hours=hour)
        report, rows = reconcile.changed_results(reconcile_one(spark, quantity, deltas), records, F.lit(at))
        stored.append([r["difference"] for r in rows.collect()])
        if hour == 1:
            assert report.first()["reconciled_at"] == T0
        records = spark.createDataFrame(records.collect() + rows.select(*records.columns).collect(), RECONCILIATION_RECORDS)
    assert stored == [[-2], [], [-4], [0]]


def test_repeated_sales_fold_the_ledger_once(spark):
    rows = [("E1", "X1", 3, "1.50", 1), ("E2", "X1", 5, "9.00", 2), ("E3", "X2", 99, None, 3), ("E4", "X2", 1, None, 4),
            ("E5", None, 1, "2.00", 5), ("E6", "X2", 2, "7.00", 6), ("E7", "X3", 99, None, 7), ("E8", "X3", 99, None, 8)]
    events = spark.createDataFrame(
        [(e, "P", "S", x, q, p, at) for e, x, q, p, at in rows],
        "event_id string, product_id string, store_id string, sale_id string, quantity_sold int, price string, at int"
    ).selectExpr("*", "cast(price AS decimal(12,2)) AS sale_price").drop("price")
    stock = spark.createDataFrame([("P", "S", 50)], "product_id string, store_id string, quantity long")
    again = sales.duplicate_sales(sales.post_sales(events, order=["at"], balances=stock))
    assert sorted((r["event_id"], r["sale_id"], r["original_quantity"], str(r["original_price"]))
                  for r in again.collect()) == [("E2", "X1", 3, "1.50"), ("E6", "X2", 1, "None")]
    assert again._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
