"""Stored anomalies: K9, A4, A5, U1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.schemas import ANOMALY_STATUSES, SEVERITIES


def new_anomalies(detected: DataFrame, stored: DataFrame | None = None, *, one_per_event: bool = False) -> DataFrame:
    """K9: anomalies not stored yet. Rows without an event id are always new.

    An event may fire several rules and keeps one anomaly per rule; with ``one_per_event`` only the first rule in
    order counts, and an event that already has any anomaly gets no further one.
    """
    key = ["event_id"] if one_per_event else ["event_id", "anomaly_type"]
    untied = detected.where(F.col("event_id").isNull())
    tied = detected.where(F.col("event_id").isNotNull())
    if stored is not None:
        tied = tied.join(stored.where("event_id is not null").select(*key), key, "left_anti")
    place = "rule_no" if "rule_no" in detected.columns else "anomaly_type"
    rest = [c for c in detected.columns if c not in key]
    first = tied.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(place, "id")).alias("first"))
    first = first.select(*key, "first.*").select(*detected.columns)
    return untied.unionByName(first)


def anomaly_stats(anomalies: DataFrame) -> DataFrame:
    """A4 in one pass: total, per status, per severity."""
    return anomalies.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ANOMALY_STATUSES],
        *[F.count_if(F.col("severity") == s).alias(s) for s in reversed(SEVERITIES)])


def anomaly_type_counts(anomalies: DataFrame) -> DataFrame:
    """A5."""
    return anomalies.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("anomalies"))


def anomaly_stats_with_types(anomalies: DataFrame) -> DataFrame:
    """A4 with the type counts as a map. The map has one entry per rule type."""
    types = anomaly_type_counts(anomalies).agg(
        F.map_from_entries(F.collect_list(F.struct("anomaly_type", "anomalies"))).alias("anomaly_types_count"))
    return anomaly_stats(anomalies).join(F.broadcast(types))


def apply_status_changes(anomalies: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updated anomalies, commands whose target does not exist).

    ``commands`` has (seq, target_id, status, at, resolved_at). Any status may follow any other. Resolving sets
    resolved_at to the given time or to the time of the command; other statuses leave it alone.
    """
    resolving = F.col("status") == "resolved"
    resolved_at = F.coalesce("resolved_at", "at")
    last = commands.where(F.col("status").isin(*ANOMALY_STATUSES)).groupBy("target_id").agg(
        F.max_by("status", "seq").alias("_status"),
        F.max_by(F.when(resolving, resolved_at), F.when(resolving, F.col("seq"))).alias("_resolved_at"))
    joined = anomalies.join(last, anomalies["id"] == last["target_id"], "left")
    updated = joined.withColumns({
        "status": F.coalesce("_status", "status"), "resolved_at": F.coalesce("_resolved_at", "resolved_at"),
    }).select(*anomalies.columns)
    return updated, unknown_targets(commands, anomalies)


def unknown_targets(commands: DataFrame, table: DataFrame) -> DataFrame:
    return commands.join(table.select(F.col("id").alias("target_id")), "target_id", "left_anti")
