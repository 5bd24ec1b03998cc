"""Alerts: F13, U2-U5, K8, A6, S5, J10, J12, and the two optional views X1 / X2."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import texts
from ledgerline.functions.columns import seconds_between, stable_id
from ledgerline.operators.anomalies import unknown_targets
from ledgerline.operators.deadletter import TIMESTAMP_FORMAT
from ledgerline.operators.kernels import DedupKernel
from ledgerline.operators.ordered_fold import HOT_ROWS, STATE, ordered_fold
from ledgerline.schemas import ALERT_DEDUP_WINDOW_SECONDS, ALERT_SEVERITIES, ALERT_STATUSES

# Columns of an alert message, in order.
MESSAGE = ("id", "anomaly_id", "inventory_id", "event_id", "severity", "status", "title", "description",
           "triggered_at", "acknowledged_at", "acknowledged_by", "resolved_at", "suppressed_until")
# Command and the status it sets.
COMMANDS = {"acknowledge": "acknowledged", "resolve": "resolved", "suppress": "suppressed"}


def alert_candidates(anomalies: DataFrame, *, critical: bool = True, high: bool = True) -> DataFrame:
    """F13 + J12 + U5: anomalies severe enough to alert on, as untriggered alerts at their detection time."""
    enabled = [s for s, on in (("critical", critical), ("high", high)) if on]
    return anomalies.where(F.col("severity").isin(enabled)).select(
        F.col("id").alias("anomaly_id"), "inventory_id", "event_id", "severity", "anomaly_type",
        F.concat(F.lit(texts.ALERT_TITLE), F.col("anomaly_type")).alias("title"), "description",
        F.col("detected_at").alias("at"))


def deduplicate(
    candidates: DataFrame,
    *,
    key: Sequence[str] = ("anomaly_id",),
    order: Sequence[str] = ("at", "anomaly_id"),
    window_seconds: int = ALERT_DEDUP_WINDOW_SECONDS,
    alerts: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """K8: every candidate with ``created`` and the ``triggered_at`` of the alert that stands for it.

    A candidate is absorbed while an unresolved alert of the same ``key`` was triggered within the window before
    it. The window stays where the last created alert put it. Inside one event stream every detection makes a new
    anomaly, so ``key=("inventory_id", "anomaly_type")`` is what suppresses repeats there. ``alerts`` needs the
    key columns.
    """
    rows = candidates.withColumn("at_micros", F.unix_micros("at"))
    openings = None
    if alerts is not None:
        openings = alerts.where(F.col("status") != "resolved").groupBy(*key).agg(
            F.max(F.unix_micros("triggered_at")).alias(STATE))
    folded = ordered_fold(rows, DedupKernel(window_seconds * 1_000_000), key=key, order=order, openings=openings,
                          hot_rows=hot_rows)
    return folded.withColumn("triggered_at", F.timestamp_micros("anchor_micros")).drop("at_micros", "anchor_micros")


def alert_rows(deduplicated: DataFrame) -> DataFrame:
    """Created candidates in the shape of the alerts table."""
    nothing, no_time = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    at = F.col("triggered_at")
    return deduplicated.where("created").select(
        stable_id(F.lit("alert"), "anomaly_id", F.unix_micros(at).cast("string")).alias("id"), "anomaly_id",
        "inventory_id", "event_id", "severity", F.lit("triggered").alias("status"), "title", "description", at,
        no_time.alias("acknowledged_at"), nothing.alias("acknowledged_by"), no_time.alias("resolved_at"),
        no_time.alias("suppressed_until"), at.alias("created_at"), at.alias("updated_at"))


def latest_open(alerts: DataFrame) -> DataFrame:
    """The newest unresolved alert of each anomaly."""
    rest = [c for c in alerts.columns if c != "anomaly_id"]
    newest = alerts.where(F.col("status") != "resolved").groupBy("anomaly_id").agg(
        F.max_by(F.struct(*rest), F.struct("triggered_at", "id")).alias("alert"))
    return newest.select("anomaly_id", "alert.*").select(*alerts.columns)


def apply_commands(alerts: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updated alerts, commands whose target does not exist).

    ``commands`` has (seq, target_id, command, at, actor, until) with command acknowledge, resolve or suppress.
    No transition is forbidden, so the last command sets the status and each kind sets its own columns. Commands of
    any other kind change nothing and are returned with those whose target does not exist.
    """
    def last(kind: str, value: Column) -> Column:
        mine = F.col("command") == kind
        return F.max_by(F.when(mine, value), F.when(mine, F.col("seq")))

    status = F.create_map(*[F.lit(x) for pair in COMMANDS.items() for x in pair])
    known = F.coalesce(F.col("command").isin(*COMMANDS), F.lit(False))
    changes = commands.where(known).groupBy("target_id").agg(
        F.max_by(F.try_element_at(status, F.col("command")), "seq").alias("_status"),
        last("acknowledge", F.col("at")).alias("_acknowledged_at"),
        last("acknowledge", F.col("actor")).alias("_acknowledged_by"),
        last("resolve", F.col("at")).alias("_resolved_at"),
        last("suppress", F.col("until")).alias("_suppressed_until"),
        F.max_by("at", "seq").alias("_updated_at"))
    joined = alerts.join(changes, alerts["id"] == changes["target_id"], "left")
    updated = joined.withColumns({
        c: F.coalesce(f"_{c}", c) for c in ("status", "acknowledged_at", "acknowledged_by", "resolved_at",
                                            "suppressed_until", "updated_at")}).select(*alerts.columns)
    odd = commands.where(~known).join(alerts.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return updated, unknown_targets(commands, alerts).unionByName(odd)


def alert_stats(alerts: DataFrame) -> DataFrame:
    """A6 in one pass. An average of exactly zero seconds reads as NULL."""
    def mean(column: str) -> Column:
        return F.nullif(F.avg(seconds_between(F.col("triggered_at"), F.col(column))), F.lit(0.0))

    return alerts.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ALERT_STATUSES],
        *[F.count_if(F.col("severity") == s).alias(s) for s in reversed(ALERT_SEVERITIES)],
        mean("acknowledged_at").alias("avg_ack_time"), mean("resolved_at").alias("avg_resolution_time"))


def alert_messages(alerts: DataFrame) -> DataFrame:
    """Key and JSON value per alert; nulls are written out and times carry their offset."""
    options = {"ignoreNullFields": "false", "timestampFormat": TIMESTAMP_FORMAT}
    return alerts.select(F.col("id").alias("key"), F.to_json(F.struct(*MESSAGE), options).alias("value"))


def stale_alerts(alerts: DataFrame, as_of: Column, timeout_seconds: int = 3600) -> DataFrame:
    """X1 (described but not enforced by the service): triggered alerts nobody acknowledged in time."""
    age = F.unix_micros(as_of) - F.unix_micros("triggered_at")
    return alerts.where((F.col("status") == "triggered") & (age > timeout_seconds * 1_000_000))


def effective_status(alerts: DataFrame, as_of: Column) -> DataFrame:
    """X2 (described but not enforced by the service): a suppression that has run out reads as triggered."""
    over = (F.col("status") == "suppressed") & (F.col("suppressed_until") <= as_of)
    return alerts.withColumn("effective_status", F.when(over, "triggered").otherwise(F.col("status")))
