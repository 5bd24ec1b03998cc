"""Audit trail against the current snapshot: A2, A3, J6-J8, K10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.columns import stable_id

PAIR = ("store_id", "product_id")


def expected_quantities(history: DataFrame) -> DataFrame:
    """A2: sum of all recorded changes per inventory row."""
    return history.groupBy("inventory_id").agg(
        F.coalesce(F.sum(F.col("quantity_delta").cast("long")), F.lit(0)).alias("expected_quantity"))


def reconcile(pairs: DataFrame, inventory: DataFrame, history: DataFrame) -> DataFrame:
    """A3 for any number of (store_id, product_id) pairs; pairs without an inventory row are ``missing``."""
    stocked = inventory.select(F.col("warehouse_id").alias("store_id"), F.col("sku").alias("product_id"),
                               F.col("id").alias("inventory_id"), F.col("quantity").cast("long").alias("on_hand"))
    joined = (
        pairs.select(*PAIR).join(stocked, list(PAIR), "left")
        .join(expected_quantities(history), "inventory_id", "left")
    )
    known = F.col("inventory_id").isNotNull()
    expected = F.when(known, F.coalesce("expected_quantity", F.lit(0))).otherwise(F.lit(0))
    actual = F.when(known, F.col("on_hand")).otherwise(F.lit(0))
    return joined.select(
        *PAIR, expected.alias("expected_quantity"), actual.alias("actual_quantity"),
        (actual - expected).alias("difference"),
        F.when(~known, "missing").when(actual == expected, "match").otherwise("mismatch").alias("status"))


def latest_records(records: DataFrame) -> DataFrame:
    """Newest stored record per pair."""
    return records.groupBy(*PAIR).agg(
        F.max_by(F.struct("status", "difference", "reconciled_at"), F.struct("reconciled_at", "id")).alias("latest"))


def changed_results(results: DataFrame, records: DataFrame, reconciled_at: Column) -> tuple[DataFrame, DataFrame]:
    """(what to report, what to store).

    Only a change of (status, difference) against the newest record is stored; an unchanged pair reports the
    time of that record.
    """
    compared = results.join(latest_records(records), list(PAIR), "left").withColumn(
        "changed",
        ~((F.col("latest.status").eqNullSafe(F.col("status")))
          & (F.col("latest.difference").cast("long").eqNullSafe(F.col("difference")))))
    report = compared.select(
        *results.columns, F.when(F.col("changed"), reconciled_at).otherwise(F.col("latest.reconciled_at"))
        .alias("reconciled_at"), "changed")
    return report, record_rows(report.where("changed"))


def record_rows(report: DataFrame) -> DataFrame:
    at = F.col("reconciled_at")
    return report.select(
        stable_id(F.lit("reconciliation"), *PAIR, F.unix_micros(at).cast("string")).alias("id"), *PAIR,
        "expected_quantity", "actual_quantity", "difference",
        "status", "reconciled_at", at.alias("created_at"), at.alias("updated_at"))
