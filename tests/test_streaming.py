"""The streaming job: routing, replay, restart, and agreement with one batch run."""

import json
import os
import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.validation import good, validate_stock_events
from ledgerline.operators import balance
from ledgerline.operators.rules import RuleEngine
from ledgerline.schemas import ENVELOPE, INVENTORY_TOPIC, SALES_TOPIC
from ledgerline.sources.streams import folder_sink, folder_stream, sales_event_messages, stock_event_messages
from ledgerline.streaming.jobs import process_batch, run_ledger
from ledgerline.streaming.store import Store

START = datetime(2026, 7, 13, 10, tzinfo=timezone.utc)


def uid(n):
    return str(uuid.UUID(int=n))


def stock(n, product, operation, quantity, **extra):
    return INVENTORY_TOPIC, {"event_id": uid(n), "product_id": product, "store_id": "S1", "operation": operation,
                             "quantity": quantity, "timestamp": "2026-07-13T09:00:00Z", **extra}


def sale(n, sale_id, product, quantity, price=None):
    return SALES_TOPIC, {"event_id": uid(n), "sale_id": sale_id, "product_id": product, "store_id": "S1",
                         "quantity_sold": quantity, "sale_price": price, "timestamp": "2026-07-13T09:30:00Z"}


BATCHES = [
    [stock(1, "A", "RESTOCK", 20), stock(2, "A", "SALE", 3), stock(3, "B", "SALE", 1), stock(4, "B", "RESTOCK", 5),
     stock(5, "A", "RESTOCK", 0), (INVENTORY_TOPIC, "{broken")],
    [sale(6, "X1", "A", 5, "10.00"), sale(7, "X1", "A", 9), sale(8, "X2", "C", 1), sale(9, "X3", "B", 50),
     stock(2, "A", "SALE", 3), stock(3, "B", "SALE", 1)],
    [stock(10, "A", "MANUAL_ADJUSTMENT", -11), sale(11, "X1", "A", 1), sale(1, "X4", "A", 1), sale(12, "X5", "B", 2)],
]


def write_batches(root, batches):
    root.mkdir(parents=True, exist_ok=True)
    offset = 0
    for number, records in enumerate(batches):
        lines = []
        for topic, payload in records:
            value = payload if isinstance(payload, str) else json.dumps(payload)
            lines.append(json.dumps({"value": value, "topic": topic, "partition": 0, "offset": offset}))
            offset += 1
        path = root / f"{number:03d}.json"
        if not path.exists():
            path.write_text("\n".join(lines))
            # The source takes files by age, and files of one moment in any order.
            os.utime(path, (1_700_000_000 + number,) * 2)


def run(spark, source, store, checkpoint):
    query = run_ledger(folder_stream(spark, str(source), max_files=1), store, str(checkpoint), clock=lambda b: START + timedelta(minutes=b),
                       available_now=True, deliver=folder_sink(f"{store.root}-sent"))
    query.awaitTermination(600)
    assert query.exception() is None


def all_rows(store, name, *columns):
    frame = store.before(name, 1000)
    return sorted(tuple(r) for r in frame.select(*columns).collect())


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stream")
    store = Store(spark, str(root / "out"), compact_every=2)
    write_batches(root / "in", BATCHES[:2])
    run(spark, root / "in", store, root / "check")
    # A second start continues where the first one stopped.
    write_batches(root / "in", BATCHES)
    run(spark, root / "in", store, root / "check")
    return store


def test_balances_and_history(finished):
    latest = {r["product_id"]: r["quantity"] for r in finished.balances_before(3).collect()}
    assert latest == {"A": 1, "B": 2}
    assert all_rows(finished, "inventory_history", "quantity_before", "quantity_after", "change_type") == sorted([
        (0, 20, "restock"), (20, 17, "sale"), (0, 5, "restock"), (17, 12, "sale"), (5, 4, "sale"), (12, 1, "adjustment"),
        (4, 2, "sale")])
    assert all_rows(finished, "sales", "external_sale_id", "quantity_sold") == [("X1", 5), ("X5", 2)]


def test_dead_letters(finished):
    reasons = sorted(json.loads(v)["failure_reason"] for (v,) in all_rows(finished, "dlq", "value"))
    negative = "non_retryable_failure:inventory quantity cannot be negative after applying event"
    assert reasons == sorted([
        "invalid_event_payload", "invalid_event_payload", negative,
        "non_retryable_failure:no inventory record for product_id='C' store_id='S1'",
        "non_retryable_failure:insufficient stock: available=4, requested=50",
        "non_retryable_failure:event_id already recorded in history"])
    # Sales failures are published but not stored.
    assert [r for (r,) in all_rows(finished, "failed_events", "failure_reason")] == [
        "invalid_event_payload", "invalid_event_payload", negative]


def test_batch_log(finished):
    assert all_rows(finished, "batch_log", "batch_id", "successful_events", "failed_events", "duplicate_events", "status") == [
        (0, 3, 1, 0, "partial_failure"), (1, 2, 2, 2, "partial_failure"), (2, 2, 1, 1, "partial_failure")]


def test_detection_follows_stock_events(finished):
    found = all_rows(finished, "anomalies", "event_id", "anomaly_type", "severity")
    assert (uid(10), "large_inventory_adjustment", "high") not in found
    assert (uid(10), "large_inventory_adjustment", "medium") in found
    assert (uid(1), "large_inventory_adjustment", "medium") in found


def test_replaying_a_batch_changes_nothing(spark, finished):
    names = ("inventory_history", "sales", "balances", "dlq", "failed_events", "anomalies", "alerts", "cache")
    before = {n: all_rows(finished, n, *[c for c in finished.before(n, 9).columns]) for n in names}
    rows, offset = [], sum(map(len, BATCHES[:1]))
    for i, (topic, payload) in enumerate(BATCHES[1]):
        rows.append((payload if isinstance(payload, str) else json.dumps(payload), topic, 0, offset + i))
    process_batch(spark.createDataFrame(rows, ENVELOPE), 1, finished, RuleEngine(), START + timedelta(minutes=1),
                  ("anomaly_id",))
    assert {n: all_rows(finished, n, *[c for c in finished.before(n, 9).columns]) for n in names} == before


def test_replay_with_another_clock(spark, finished):
    """A replayed batch takes the time that its first run wrote down."""
    names = ("inventory_history", "sales", "balances", "dlq", "failed_events", "anomalies", "alerts", "cache")
    before = {n: all_rows(finished, n, *[c for c in finished.before(n, 9).columns]) for n in names}
    rows = [(p if isinstance(p, str) else json.dumps(p), t, 0, i) for i, (t, p) in enumerate(BATCHES[0])]
    process_batch(spark.createDataFrame(rows, ENVELOPE), 0, finished, RuleEngine(), datetime.now(timezone.utc),
                  ("anomaly_id",))
    assert {n: all_rows(finished, n, *[c for c in finished.before(n, 9).columns]) for n in names} == before


def test_readers_see_whole_batches(spark, finished):
    assert finished.committed("balances").select("batch_id").distinct().count() == 3
    finished.write("balances", 7, spark.createDataFrame([("Z", "S", 1)], "product_id string, store_id string, quantity long"))
    assert finished.committed("balances").where("product_id = 'Z'").isEmpty()
    assert not finished.before("balances", 8).where("product_id = 'Z'").isEmpty()


def test_messages_are_delivered(spark, finished):
    sent = spark.read.schema("key string, value string").json(f"{finished.root}-sent/inventory_dlq")
    assert sorted(r["value"] for r in sent.collect()) == sorted(v for (v,) in all_rows(finished, "dlq", "value"))


def test_outcome_counters(finished):
    assert all_rows(finished, "outcomes", "batch_id", "outcome", "count") == [
        (0, "failed", 1), (0, "processed", 3), (1, "duplicate", 2), (1, "failed", 2), (1, "processed", 2),
        (2, "duplicate", 1), (2, "failed", 1), (2, "processed", 2)]


def test_streamed_history_equals_one_batch(spark, finished):
    records = [(p if isinstance(p, str) else json.dumps(p), t, 0, i)
               for i, (t, p) in enumerate(r for batch in BATCHES[:1] for r in batch)]
    checked = validate_stock_events(spark.createDataFrame(records, ENVELOPE), F.lit(START))
    ledger = balance.apply_stock_events(good(checked), order=["offset"])
    expected = sorted((r["event_id"], r["quantity_after"]) for r in balance.applied(ledger).collect())
    got = finished.before("inventory_history", 1).select("source_event_id", "quantity_after")
    assert sorted(tuple(r) for r in got.collect()) == expected


def test_published_events_validate_again(spark):
    frame = spark.createDataFrame([(uid(1), "A", "S", "SALE", 2, START)],
                                  "event_id string, product_id string, store_id string, operation string, quantity int, timestamp timestamp")
    (message,) = stock_event_messages(frame).collect()
    assert message["key"] == uid(1)
    checked = validate_stock_events(spark.createDataFrame([(message["value"], "t", 0, 0)], ENVELOPE), F.lit(START))
    assert good(checked).count() == 1
    priced = spark.sql("SELECT 'e' event_id, 's' sale_id, 'p' product_id, 't' store_id, 1 quantity_sold, "
                       "CAST(1.50 AS DECIMAL(12,2)) sale_price, TIMESTAMP '2026-01-01' timestamp")
    assert json.loads(sales_event_messages(priced).first()["value"])["sale_price"] == "1.50"
