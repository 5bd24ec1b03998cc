"""Tables, dead letter, cache and accounting on small hand-made cases."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import accounting, deadletter, snapshot
from ledgerline.operators.paging import positions
from ledgerline.schemas import SALES
from ledgerline.sources.tables import append_table, read_table, recent

T0 = datetime(2026, 7, 13, 10)


def test_tables_append_and_prune(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), "I", i, None, str(i), T0 - timedelta(days=i)) for i in range(5)], SALES)
    append_table(rows.where("quantity_sold < 3"), str(tmp_path), "sales")
    append_table(rows.where("quantity_sold >= 3"), str(tmp_path), "sales")
    stored = read_table(spark, str(tmp_path), "sales")
    assert stored.count() == 5
    late = recent(stored, "sold_at", F.lit(T0 - timedelta(days=1)))
    assert sorted(r["id"] for r in late.collect()) == ["0", "1"]
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


FAILURE = ("event_id string, source_topic string, source_partition int, source_offset long, value string, "
           "failure_reason string, retry_count int")


def test_failed_events_are_stored_once_per_location(spark):
    rows = spark.createDataFrame([("e", "t", 0, 1, '{"a": "x y",\n "b": 1}', "r", 0), ("e", "t", 0, 1, '{"a": "x y",\n "b": 1}', "r", 0),
                                  (None, "t", 0, 2, "{broken", "r", 0), (None, "t", 1, 1, None, "r", 0)], FAILURE)
    stored = deadletter.failed_event_rows(rows, F.lit(T0)).orderBy("source_partition", "source_offset").collect()
    assert [r["payload"] for r in stored] == ['{"a":"x y","b":1}', '"{broken"', "null"]
    again = deadletter.failed_event_rows(rows, F.lit(T0), spark.createDataFrame(stored))
    assert again.isEmpty()


def test_the_first_write_of_a_failed_event_wins(spark):
    rows = spark.createDataFrame([("e", "t", 0, 1, "{}", "zzz first", 0, 1), ("e", "t", 0, 1, "{}", "aaa second", 0, 2)],
                                 FAILURE + ", written int")
    (row,) = deadletter.failed_event_rows(rows, F.lit(T0), order=["written"]).collect()
    assert row["failure_reason"] == "zzz first"


def test_dead_letter_messages(spark):
    rows = spark.createDataFrame([("e", "t", 0, 1, '{"a":[1,null]}', "r", 0), (None, "t", 3, 9, "{broken", "r", 0),
                                  ("", "t", 3, 10, "[]", "r", 2)], FAILURE)
    messages = {r["key"]: json.loads(r["value"]) for r in deadletter.dlq_messages(rows, F.lit(T0)).collect()}
    assert messages["e"] == {"event_id": "e", "failure_reason": "r", "retry_count": 0, "payload": {"a": [1, None]},
                             "timestamp": "2026-07-13T10:00:00.000000+00:00", "source_topic": "t",
                             "source_partition": 0, "source_offset": 1}
    assert messages["t:3:9"]["payload"] == "{broken" and messages["t:3:9"]["event_id"] is None
    assert messages["t:3:10"]["retry_count"] == 2


ENTRIES = "key string, value string, expires_at timestamp"
OPERATIONS = "seq long, key string, value string, ttl_seconds int"


def test_cache_operations(spark):
    entries = spark.createDataFrame([("a", "1", None), ("b", "2", None), ("old", "3", T0)], ENTRIES)
    operations = spark.createDataFrame([(0, "a", None, None), (1, "c", "4", 60), (2, "c", "5", 0), (3, "d", "6", 60),
                                        (4, "e", None, None), (5, "a", None, None), (6, "old", None, None)], OPERATIONS)
    after = snapshot.apply_operations(entries, operations, F.lit(T0))
    assert sorted((r["key"], r["value"], r["expires_at"]) for r in after.collect()) == [
        ("b", "2", None), ("c", "5", None), ("d", "6", T0 + timedelta(seconds=60))]
    assert tuple(snapshot.operation_counts(entries, operations, F.lit(T0)).first()) == (4, 3)
    keys = spark.createDataFrame([("a",), ("x",), ("old",)], "key string")
    assert tuple(snapshot.get_counts(snapshot.get_keys(entries, keys, F.lit(T0))).first()) == (1, 2)
    # The expired entry counts as gone, and a key listed twice is deleted once.
    assert tuple(snapshot.delete_counts(entries, keys.unionByName(keys), F.lit(T0)).first()) == (1, 5)
    assert snapshot.delete_keys(entries, keys).count() == 1
    new = spark.createDataFrame([("a", "9"), ("z", "8")], "key string, value string")
    assert sorted((r["key"], r["value"]) for r in snapshot.overwrite_keys(entries, new).collect()) == [
        ("a", "9"), ("b", "2"), ("old", "3"), ("z", "8")]


def test_batches_close_by_count(spark):
    rows = spark.createDataFrame([(i, "applied" if i % 7 else "duplicate" if i else "rejected") for i in range(25)],
                                 "seq int, status string").repartition(3)
    rows = rows.withColumns({"event_id": F.col("seq").cast("string"), "product_id": F.lit("P"), "store_id": F.lit("S"),
                             "quantity_before": F.lit(0), "delta": F.lit(1)})
    log = accounting.cut_batches(accounting.event_log(rows), ["seq"], 10).withColumn("ms", F.lit(1.0))
    batches = accounting.batch_outcomes(log, time_ms="ms").orderBy("batch_no").collect()
    assert [(b["total_events"], b["successful_events"], b["failed_events"], b["duplicate_events"], b["status"])
            for b in batches] == [(10, 8, 1, 1, "partial_failure"), (10, 9, 0, 1, "completed"), (5, 4, 0, 1, "completed")]
    assert [r["event_id"] for r in accounting.batch_errors(log).collect()] == ["0"]
    metrics = accounting.batch_metrics(accounting.batch_outcomes(log, time_ms="ms")).first()
    assert (metrics["total_batches_processed"], metrics["total_processing_time_ms"], metrics["min_batch_processing_time_ms"],
            metrics["avg_batch_processing_time_ms"], metrics["total_partial_failures"]) == (3, 25.0, 5.0, 8.33, 1)
    nothing = accounting.batch_metrics(accounting.batch_outcomes(log.limit(0), time_ms="ms")).first()
    assert (nothing["total_events_processed"], nothing["min_batch_processing_time_ms"]) == (0, 0.0)
    with pytest.raises(ValueError):
        accounting.cut_batches(rows, ["seq"], 0)


def test_positions_are_dense(spark):
    rows = spark.range(1000).repartition(7)
    placed = positions(rows, [F.desc("id")])
    assert placed.where(F.col("position") != 999 - F.col("id")).isEmpty() and placed.count() == 1000


def test_histogram_and_counters(spark):
    seen = spark.createDataFrame([("ok", 0.005), ("ok", 0.3), ("ok", 99.0), ("bad", 0.0), ("bad", -1.0)], "outcome string, seconds double")
    counted = {(r["outcome"], r["le"]): r["observations"] for r in accounting.duration_histogram(seen).collect()}
    assert [counted["ok", le] for le in ("0.001", "0.005", "0.25", "0.5", "10.0", "+Inf")] == [0, 1, 1, 2, 2, 3]
    assert counted["bad", "+Inf"] == 1 and len(counted) == 26
    assert {r["outcome"]: r["total"] for r in accounting.outcome_counters(seen).collect()} == {"ok": 3, "bad": 2}
