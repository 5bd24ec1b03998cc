"""Explicit schemas and value domains. Nothing in this package infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

# Enum domains, limits and patterns of the event contract.
OPERATIONS = ("SALE", "RESTOCK", "RETURN", "MANUAL_ADJUSTMENT")
POSITIVE_OPERATIONS = ("SALE", "RESTOCK", "RETURN")
CHANGE_TYPES = ("sync", "adjustment", "sale", "restock", "return")
SEVERITIES = ("low", "medium", "high", "critical")
ANOMALY_STATUSES = ("open", "investigating", "resolved")
ALERT_STATUSES = ("triggered", "acknowledged", "resolved", "suppressed")
ALERT_SEVERITIES = ("high", "critical")
RECONCILIATION_STATUSES = ("match", "mismatch", "missing")
BATCH_STATUSES = ("queued", "processing", "completed", "failed", "partial_failure")
IDENTIFIER_PATTERN = r"\A[A-Za-z0-9][A-Za-z0-9_\-:.]*\z"
IDENTIFIER_MAX_LENGTH = 128
QUANTITY_LIMIT = 1_000_000
MAX_FUTURE_SKEW_SECONDS = 300
ALERT_DEDUP_WINDOW_SECONDS = 300
DEFAULT_BATCH_SIZE = 100
INVENTORY_TOPIC = "inventory_updates"
SALES_TOPIC = "sales_events"
DLQ_TOPIC = "inventory_dlq"
ALERT_TOPIC = "inventory_alerts"
DURATION_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
_TS, _D, _MONEY = T.TimestampType(), T.DoubleType(), T.DecimalType(12, 2)

# One record as a broker delivers it; ``value`` is the JSON text.
ENVELOPE = _struct(("value", _S, True), ("topic", _S, False), ("partition", _I, False), ("offset", _L, False))

# Payload fields are read as text first so that bad values become reasons, not nulls or job failures.
RAW_INVENTORY_EVENT = _struct(*[(n, _S, True) for n in
                                ("event_id", "product_id", "store_id", "operation", "quantity", "timestamp")])
RAW_SALES_EVENT = _struct(*[(n, _S, True) for n in
                            ("event_id", "sale_id", "product_id", "store_id", "quantity_sold", "sale_price",
                             "timestamp")])

# Balances and everything summed from them are 64-bit: a busy key can pass 2^31, and must not fail a job.
INVENTORY = _struct(("id", _S, False), ("sku", _S, False), ("warehouse_id", _S, False), ("quantity", _L, False),
                    ("reorder_level", _I, False), ("is_active", _B, False), ("created_at", _TS, False),
                    ("updated_at", _TS, False))
INVENTORY_HISTORY = _struct(("id", _S, False), ("inventory_id", _S, False), ("change_type", _S, False),
                            ("quantity_before", _L, False), ("quantity_after", _L, False),
                            ("quantity_delta", _L, False), ("source_event_id", _S, True), ("changed_at", _TS, False))
SALES = _struct(("id", _S, False), ("inventory_id", _S, False), ("quantity_sold", _I, False),
                ("sale_price", _MONEY, True), ("external_sale_id", _S, True), ("sold_at", _TS, False))
ANOMALIES = _struct(("id", _S, False), ("inventory_id", _S, False), ("event_id", _S, True),
                    ("anomaly_type", _S, False), ("severity", _S, False), ("score", _D, False),
                    ("status", _S, False), ("description", _S, True), ("detected_at", _TS, False),
                    ("resolved_at", _TS, True))
PROCESSED_EVENTS = _struct(("id", _S, False), ("event_id", _S, False), ("product_id", _S, False),
                           ("store_id", _S, False), ("status", _S, False), ("processed_at", _TS, False))
# Broker offsets are 64-bit, so the offset is too.
FAILED_EVENTS = _struct(("id", _S, False), ("event_id", _S, True), ("source_topic", _S, False),
                        ("source_partition", _I, False), ("source_offset", _L, False), ("payload", _S, False),
                        ("failure_reason", _S, False), ("retry_count", _I, False), ("failed_at", _TS, False))
ALERTS = _struct(("id", _S, False), ("anomaly_id", _S, False), ("inventory_id", _S, False), ("event_id", _S, True),
                 ("severity", _S, False), ("status", _S, False), ("title", _S, False), ("description", _S, True),
                 ("triggered_at", _TS, False), ("acknowledged_at", _TS, True), ("acknowledged_by", _S, True),
                 ("resolved_at", _TS, True), ("suppressed_until", _TS, True), ("created_at", _TS, False),
                 ("updated_at", _TS, False))
RECONCILIATION_RECORDS = _struct(("id", _S, False), ("store_id", _S, False), ("product_id", _S, False),
                                 ("expected_quantity", _L, False), ("actual_quantity", _L, False),
                                 ("difference", _L, False), ("status", _S, False), ("reconciled_at", _TS, False),
                                 ("created_at", _TS, False), ("updated_at", _TS, False))

TABLES: dict[str, T.StructType] = {
    "inventory": INVENTORY,
    "inventory_history": INVENTORY_HISTORY,
    "sales": SALES,
    "anomalies": ANOMALIES,
    "processed_events": PROCESSED_EVENTS,
    "failed_events": FAILED_EVENTS,
    "alerts": ALERTS,
    "reconciliation_records": RECONCILIATION_RECORDS,
}
