"""Latest-state cache as keyed tables: S10-S14.

A snapshot is a DataFrame (key, value, expires_at); ``expires_at`` is NULL for entries that stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import snapshot_key
from ledgerline.operators.deadletter import TIMESTAMP_FORMAT


def latest_state(ledger: DataFrame, *, order: Sequence[str], synced_at: Column) -> DataFrame:
    """The last applied event per pair as (key, JSON value). Duplicates never touch the cache."""
    at = F.struct(*order)
    last = ledger.where(F.col("status") == "applied").groupBy("product_id", "store_id").agg(
        F.max_by(F.struct("quantity_after", "operation", "event_id"), at).alias("last"))
    body = F.struct(
        "product_id", "store_id", F.col("last.quantity_after").alias("quantity"), "last.operation",
        F.col("last.event_id").alias("source_event_id"), synced_at.alias("synced_at"))
    return last.select(
        snapshot_key(F.col("store_id"), F.col("product_id")).alias("key"),
        F.to_json(body, {"ignoreNullFields": "false", "timestampFormat": TIMESTAMP_FORMAT}).alias("value"))


def apply_operations(snapshot: DataFrame, operations: DataFrame, as_of: Column) -> DataFrame:
    """Set, set with expiry, or delete (NULL value); the operation with the highest ``seq`` wins per key.

    ``operations`` has (seq, key, value, ttl_seconds); a zero or missing ttl means no expiry.
    """
    expires = F.when(F.coalesce("ttl_seconds", F.lit(0)) != 0,
                     F.timestamp_micros(F.unix_micros(as_of) + F.col("ttl_seconds").cast("long") * 1_000_000))
    changes = operations.select("key", "value", expires.alias("expires_at"), F.col("seq").cast("long").alias("seq"))
    before = snapshot.select("key", "value", "expires_at", F.lit(-(1 << 62)).cast("long").alias("seq"))
    merged = before.unionByName(changes).groupBy("key").agg(
        F.max_by(F.struct("value", "expires_at"), "seq").alias("last"))
    return live(merged.select("key", "last.value", "last.expires_at"), as_of)


def live(snapshot: DataFrame, as_of: Column) -> DataFrame:
    return snapshot.where(F.col("value").isNotNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))


def operation_counts(snapshot: DataFrame, operations: DataFrame, as_of: Column) -> DataFrame:
    """(successful, failed) of S11: a set always succeeds; a delete succeeds when its key exists at that moment."""
    # Whether a key exists only depends on the operation before, or on the snapshot for the first one.
    before = F.lag(F.col("value").isNotNull()).over(Window.partitionBy("key").orderBy("seq"))
    there = live(snapshot, as_of).select("key", F.lit(True).alias("there"))
    judged = operations.withColumn("before", before).join(there, "key", "left").select(
        (F.col("value").isNotNull() | F.coalesce("before", "there", F.lit(False))).alias("succeeded"))
    return judged.agg(F.count_if("succeeded").alias("successful"), F.count_if(~F.col("succeeded")).alias("failed"))


def delete_keys(snapshot: DataFrame, keys: DataFrame) -> DataFrame:
    """The snapshot without these keys."""
    return snapshot.join(keys.select("key"), "key", "left_anti")


def delete_counts(snapshot: DataFrame, keys: DataFrame, as_of: Column) -> DataFrame:
    """(deleted, failed) of S12. A key that is not there (any more) fails; one listed twice is deleted once."""
    found = keys.select("key").distinct().join(live(snapshot, as_of).select("key"), "key", "left_semi")
    deleted = found.agg(F.count(F.lit(1)).alias("deleted"))
    # Two one-row results side by side.
    return deleted.join(F.broadcast(keys.agg(F.count(F.lit(1)).alias("requested")))).select(
        "deleted", (F.col("requested") - F.col("deleted")).alias("failed"))


def get_keys(snapshot: DataFrame, keys: DataFrame, as_of: Column) -> DataFrame:
    """One row per requested key; a miss has a NULL value."""
    return keys.select("key").join(live(snapshot, as_of).select("key", "value"), "key", "left")


def get_counts(looked_up: DataFrame) -> DataFrame:
    return looked_up.agg(
        F.count_if(F.col("value").isNotNull()).alias("found"), F.count_if(F.col("value").isNull()).alias("missing"))


def overwrite_keys(snapshot: DataFrame, entries: DataFrame) -> DataFrame:
    """Bulk set without expiry; ``entries`` has one (key, value) per key."""
    kept = snapshot.join(entries.select("key"), "key", "left_anti")
    return kept.unionByName(entries.select("key", "value", F.lit(None).cast("timestamp").alias("expires_at")))
