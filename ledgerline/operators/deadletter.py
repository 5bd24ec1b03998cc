"""Failed records: F7, F8, S6, S8, R6."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import texts
from ledgerline.functions.columns import stable_id
from ledgerline.functions.validation import bad

LOCATION = ("source_topic", "source_partition", "source_offset")
# Outside of string literals, white space in JSON means nothing.
_LITERAL_OR_SPACE = r'("(?:[^"\\]++|\\.)*+")|\s+'
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"


def _located(frame: DataFrame, event_id: Column, reason: Column) -> DataFrame:
    return frame.select(
        event_id.alias("event_id"), F.col("topic").alias("source_topic"), F.col("partition").alias("source_partition"),
        F.col("offset").alias("source_offset"), "value", reason.alias("failure_reason"), F.lit(0).alias("retry_count"))


def stock_failures(validated: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """Invalid stock records, and events the balance refused. The event id is kept when it can be read."""
    failures = _located(bad(validated), F.coalesce("event_id", "claimed_event_id"), F.col("failure_reason"))
    if refused is not None:
        failures = failures.unionByName(
            _located(refused, F.col("event_id"), F.concat(F.lit(f"{texts.REFUSED_BY_LEDGER}:"), F.col("reason"))))
    return failures


def sales_failures(validated: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """Invalid or refused sales; these messages never carry an event id."""
    nothing = F.lit(None).cast("string")
    failures = _located(bad(validated), nothing, F.col("failure_reason"))
    if refused is not None:
        failures = failures.unionByName(
            _located(refused, nothing, F.concat(F.lit(f"{texts.REFUSED_BY_LEDGER}:"), F.col("reason"))))
    return failures


def compact_payload(value: Column) -> Column:
    """Compact JSON text of a payload; text that is not JSON is kept as a JSON string."""
    quoted = F.to_json(F.struct(value.alias("v")))
    return (
        F.when(value.isNull(), F.lit("null"))
        .when(F.try_parse_json(value).isNotNull(), F.regexp_replace(value, _LITERAL_OR_SPACE, "$1"))
        .otherwise(F.substring(quoted, F.lit(6), F.length(quoted) - 6))
    )


def dlq_messages(failures: DataFrame, as_of: Column) -> DataFrame:
    """Key and JSON value per failure. The payload is embedded as JSON and nulls are written out."""
    payload = F.coalesce(F.try_parse_json("value"), F.col("value").cast("variant"))
    body = F.struct("event_id", "failure_reason", "retry_count", as_of.alias("timestamp"), *LOCATION,
                    payload.alias("payload"))
    options = {"ignoreNullFields": "false", "timestampFormat": TIMESTAMP_FORMAT}
    location = F.concat_ws(":", *[F.col(c).cast("string") for c in LOCATION])
    # An empty id counts as no id.
    key = F.coalesce(F.when(F.col("event_id") != "", F.col("event_id")), location)
    return failures.select(key.alias("key"), F.to_json(body, options).alias("value"))


def failed_event_rows(
    failures: DataFrame, failed_at: Column, stored: DataFrame | None = None, order: Sequence[str] = ("retry_count",)
) -> DataFrame:
    """One row per source location; the first write in ``order`` wins, also against what is already stored."""
    if stored is not None:
        failures = failures.join(stored.select(*LOCATION), list(LOCATION), "left_anti")
    facts = F.struct(F.col("failure_reason"), F.col("event_id"), F.col("value"), F.col("retry_count"))
    first = failures.groupBy(*LOCATION).agg(F.min_by(facts, F.struct(*order, facts)).alias("first"))
    return first.select(
        stable_id(F.lit("failed"), *[F.col(c).cast("string") for c in LOCATION]).alias("id"),
        "first.event_id", *LOCATION, compact_payload(F.col("first.value")).alias("payload"),
        "first.failure_reason", "first.retry_count", failed_at.alias("failed_at"))
