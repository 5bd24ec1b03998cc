"""Stored tables, messages and commands derived from the shared ``events`` table.

They give the listing, lifecycle, cache and dead-letter operators real input that grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.columns import inventory_id, signed_delta
from ledgerline.schemas import INVENTORY_TOPIC, SALES_TOPIC
from ledgerline.sources import domain

MICROS = 1_000_000
# 2024-02-01, just after the last event of the sample tables.
AS_OF_MICROS = 1_706_745_600 * MICROS


def as_of() -> Column:
    return F.timestamp_micros(F.lit(AS_OF_MICROS))


def _seconds_after(column: str, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(column) + seconds.cast("long") * MICROS)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock events with the raw columns next to them."""
    raw = domain.read(spark, sf_dir, "events").select(
        F.col("event_id").alias("event_no"), F.col("event_type"), F.col("value"), F.col("user_id"),
        F.col("ts").cast("timestamp").alias("ts"))
    return raw.withColumns({
        "event_id": domain.numbered_uuid("00000000-0000-4000-8000-", F.col("event_no")),
        "product_id": F.concat(F.lit("SKU-"), F.col("user_id").cast("string")),
        "store_id": F.concat(F.lit("STORE-"), (F.col("user_id") % 7).cast("string")),
    }).withColumn("inventory_id", inventory_id("store_id", "product_id"))


def replayed(events: DataFrame, every: int = 5) -> DataFrame:
    """Every ``every``-th event delivered a second time, one hour later."""
    again = events.where(F.col("event_no") % every == 0).withColumns({
        "ts": _seconds_after("ts", F.lit(3600)), "copy": F.lit(1)})
    return events.withColumn("copy", F.lit(0)).unionByName(again)


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock events as broker records; some of them are broken in ways that depend on the event number mod 11."""
    events = domain.stock_events(spark, sf_dir)
    kind = F.col("event_no") % 11
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    far = F.lit("2099-01-01T00:00:00")
    fields = F.struct(
        F.when(kind == 8, F.lit("not-a-uuid")).otherwise(F.col("event_id")).alias("event_id"),
        F.when(kind == 1, F.lit(" ")).otherwise(F.col("product_id")).alias("product_id"),
        "store_id",
        F.when(kind == 6, F.lower("operation")).otherwise(F.col("operation")).alias("operation"),
        F.when(kind == 2, F.lit(0)).when(kind == 7, F.lit(2_000_000)).otherwise(F.col("quantity")).alias("quantity"),
        F.when(kind == 3, stamp).when(kind == 4, F.concat(far, F.lit("Z")))
        .otherwise(F.concat(stamp, F.lit("Z"))).alias("timestamp"),
    )
    document = F.to_json(fields)
    value = F.when(kind == 5, F.substring(document, 1, 20)).when(kind == 9, F.concat(F.lit("["), document, F.lit("]")))
    return events.select(
        value.otherwise(document).alias("value"), F.lit(INVENTORY_TOPIC).alias("topic"),
        (F.col("event_no") % 3).cast("int").alias("partition"), F.col("event_no").alias("offset"))


def sales_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales as broker records; some are broken in ways that depend on order and line number mod 13.

    The price is text, an explicit null or left out, as the contract allows.
    """
    sold = domain.sales_events(spark, sf_dir)
    number = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    kind = number % 13
    stamp = F.date_format("sold_at", "yyyy-MM-dd'T'HH:mm:ss")

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))

    price = F.when(kind == 6, "-1.50").when(kind == 7, "abc").otherwise(F.col("sale_price").cast("string"))
    document = F.concat(F.lit("{"), F.concat_ws(
        ",",
        field("event_id", F.when(kind == 8, F.lit("not-a-uuid")).otherwise(
            domain.numbered_uuid("00000000-0000-4000-9000-", number))),
        field("sale_id", F.when(kind == 1, F.lit(" ")).otherwise(F.col("sale_id"))),
        field("product_id", F.col("product_id")),
        field("store_id", F.when(kind == 12, F.lit("!")).otherwise(F.col("store_id"))),
        F.concat(F.lit('"quantity_sold":'), F.when(kind == 2, F.lit(0)).otherwise(F.col("quantity_sold")).cast("string")),
        F.when(kind == 10, F.lit('"sale_price":null')).when(kind != 11, field("sale_price", price)),
        field("timestamp", F.when(kind == 3, stamp).when(kind == 4, F.lit("2099-01-01T00:00:00Z"))
              .otherwise(F.concat(stamp, F.lit("Z"))))), F.lit("}"))
    value = F.when(kind == 5, F.substring(document, 1, 20)).when(kind == 9, F.concat(F.lit("["), document, F.lit("]")))
    return sold.select(
        value.otherwise(document).alias("value"), F.lit(SALES_TOPIC).alias("topic"),
        (number % 3).cast("int").alias("partition"), number.alias("offset"))


def recorded_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history table in which every event took effect, refused by nobody."""
    events = domain.stock_events(spark, sf_dir)
    return events.select(
        F.col("event_id").alias("id"), inventory_id("store_id", "product_id").alias("inventory_id"),
        signed_delta(F.col("operation"), F.col("quantity")).alias("quantity_delta"),
        F.col("ts").alias("changed_at"), "product_id", "store_id")


def drifted_inventory(changes: DataFrame) -> DataFrame:
    """Inventory rows that partly disagree with the recorded changes, and partly are not there."""
    number = F.regexp_extract("product_id", r"(\d+)$", 1).cast("long")
    totals = changes.groupBy("product_id", "store_id").agg(F.sum("quantity_delta").alias("quantity"))
    return totals.where(number % 11 != 0).withColumn(
        "quantity", F.col("quantity") + F.when(number % 3 == 0, F.lit(2)).otherwise(F.lit(0)))


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored anomaly per ``error`` event."""
    no, value = F.col("event_no"), F.col("value")
    resolved = no % 3 == 2
    return _events(spark, sf_dir).where(F.col("event_type") == "error").select(
        domain.numbered_uuid("00000000-0000-4000-a000-", no).alias("id"), "inventory_id", "event_id",
        F.when(no % 4 == 0, "negative_inventory").when(no % 4 == 1, "sudden_sales_spike")
        .when(no % 4 == 2, "large_inventory_adjustment").otherwise("rapid_consecutive_sales").alias("anomaly_type"),
        F.when(value > 60, "critical").when(value > 30, "high").when(value > 15, "medium").otherwise("low")
        .alias("severity"),
        F.least(F.lit(100.0), value).alias("score"),
        F.when(resolved, "resolved").when(no % 3 == 1, "investigating").otherwise("open").alias("status"),
        F.concat(F.lit("sample "), no.cast("string")).alias("description"), F.col("ts").alias("detected_at"),
        F.when(resolved, _seconds_after("ts", F.ceil(value))).alias("resolved_at"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored alert per severe anomaly and per click, several of them on the same anomaly."""
    no, value = F.col("event_no"), F.col("value")
    status = (F.when(no % 4 == 0, "triggered").when(no % 4 == 1, "acknowledged").when(no % 4 == 2, "resolved")
              .otherwise("suppressed"))
    at = F.col("ts")
    return _events(spark, sf_dir).where(F.col("event_type").isin("error", "click")).select(
        domain.numbered_uuid("00000000-0000-4000-b000-", no).alias("id"),
        domain.numbered_uuid("00000000-0000-4000-a000-", F.col("user_id") * 3 + no % 3).alias("anomaly_id"),
        "inventory_id", "event_id", F.when(value > 40, "critical").otherwise("high").alias("severity"),
        status.alias("status"), F.lit("Alert: sample").alias("title"), F.lit(None).cast("string").alias("description"),
        at.alias("triggered_at"),
        F.when(no % 4 != 0, _seconds_after("ts", F.ceil(value))).alias("acknowledged_at"),
        F.when(no % 4 != 0, F.concat(F.lit("user-"), (no % 5).cast("string"))).alias("acknowledged_by"),
        F.when(no % 4 == 2, _seconds_after("ts", F.ceil(value * 3))).alias("resolved_at"),
        F.when(no % 4 == 3, _seconds_after("ts", F.ceil(value * 3600))).alias("suppressed_until"),
        at.alias("created_at"), at.alias("updated_at"))


def alert_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One command per event on some alert; about three fifths of the targets exist."""
    no = F.col("event_no")
    return _events(spark, sf_dir).select(
        no.alias("seq"), domain.numbered_uuid("00000000-0000-4000-b000-", F.floor(no / 3)).alias("target_id"),
        # Some commands are of a kind nobody knows.
        F.when(no % 10 == 9, "escalate").when(no % 5 < 2, "acknowledge").when(no % 5 == 2, "resolve")
        .otherwise("suppress").alias("command"),
        F.col("ts").alias("at"), F.concat(F.lit("user-"), (no % 9).cast("string")).alias("actor"),
        _seconds_after("ts", F.lit(7200)).alias("until"))


def anomaly_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.col("event_no")
    return _events(spark, sf_dir).select(
        no.alias("seq"), domain.numbered_uuid("00000000-0000-4000-a000-", F.floor(no / 2)).alias("target_id"),
        F.when(no % 3 == 0, "open").when(no % 3 == 1, "investigating").otherwise("resolved").alias("status"),
        F.col("ts").alias("at"),
        F.when(no % 2 == 0, _seconds_after("ts", F.lit(60))).alias("resolved_at"))


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot with one entry per product seen in a signup; every fourth entry has already expired."""
    return _events(spark, sf_dir).where(F.col("event_type") == "signup").groupBy("user_id").agg(
        F.max("event_no").alias("last")).select(
        F.concat(F.lit("inventory:"), F.col("user_id").cast("string")).alias("key"),
        F.col("last").cast("string").alias("value"),
        F.when(F.col("user_id") % 4 == 0, F.timestamp_micros(F.lit(AS_OF_MICROS - MICROS))).alias("expires_at"))


def cache_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One operation per event; errors delete, clicks expire a day later or never."""
    kind, no = F.col("event_type"), F.col("event_no")
    return _events(spark, sf_dir).where(kind != "signup").select(
        no.alias("seq"), F.concat(F.lit("inventory:"), F.col("user_id").cast("string")).alias("key"),
        F.when(kind != "error", no.cast("string")).alias("value"),
        F.when(kind == "click", (no % 2) * 86_400).cast("int").alias("ttl_seconds"))
