"""Deleting parents together with everything that belongs to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _without(child: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    return child.join(gone.select(F.col("id").alias(column)), column, "left_anti")


def delete_anomalies(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Remove anomalies (ids in ``gone``) and their alerts."""
    kept = dict(tables)
    kept["anomalies"] = _without(tables["anomalies"], "id", gone)
    kept["alerts"] = _without(tables["alerts"], "anomaly_id", gone)
    return kept


def delete_inventory(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Remove inventory rows and their history, sales, anomalies and alerts, and the alerts of those anomalies."""
    kept = dict(tables)
    if "anomalies" in tables and "alerts" in tables:
        orphaned = tables["anomalies"].join(gone.select(F.col("id").alias("inventory_id")), "inventory_id", "left_semi")
        kept["alerts"] = _without(tables["alerts"], "anomaly_id", orphaned)
    kept["inventory"] = _without(tables["inventory"], "id", gone)
    for child in ("inventory_history", "sales", "anomalies", "alerts"):
        if child in tables:
            kept[child] = _without(kept[child], "inventory_id", gone)
    return kept
