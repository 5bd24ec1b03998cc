"""Stock events to balances and audit trail: F14, K1, K2, K3, K6, K7, S9."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import texts
from ledgerline.functions.columns import change_type, inventory_id, signed_delta, stable_id
from ledgerline.operators.kernels import BalanceKernel
from ledgerline.operators.ordered_fold import HOT_ROWS, STATE, ordered_fold

PAIR = ("product_id", "store_id")


def stock_movements(events: DataFrame) -> DataFrame:
    """resolve each validated stock event to a signed movement."""
    return events.withColumns({
        "delta": signed_delta(F.col("operation"), F.col("quantity")),
        "change_type": change_type(F.col("operation")),
    })


def opening_states(balances: DataFrame) -> DataFrame:
    """Balances (product_id, store_id, quantity) as starting states of a fold."""
    return balances.select(*PAIR, F.col("quantity").cast("long").alias(STATE))


def fold_movements(
    movements: DataFrame,
    *,
    order: Sequence[str],
    balances: DataFrame | None = None,
    used_ids: dict[str, DataFrame] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Apply movements of any kind in ``order``; adds status, quantity_before, quantity_after, quantity_delta."""
    openings = None if balances is None else opening_states(balances)
    ledger = ordered_fold(movements, BalanceKernel(), key=PAIR, order=order, openings=openings,
                          used_ids=used_ids, hot_rows=hot_rows)
    return ledger.withColumn("quantity_delta", F.when(F.col("status") == "applied", F.col("delta")).otherwise(F.lit(0)))


def apply_stock_events(
    events: DataFrame,
    *,
    order: Sequence[str],
    balances: DataFrame | None = None,
    history: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """K1 + K2: guarded running balance. An event id already in ``history`` is a duplicate."""
    used = None
    if history is not None:
        used = {"event_id": history.select(F.col("source_event_id").alias("event_id")).where("event_id is not null")}
    return fold_movements(stock_movements(events), order=order, balances=balances, used_ids=used, hot_rows=hot_rows)


def applied(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("status") == "applied")


def refusal_reason() -> Column:
    """Why a ledger row was refused; NULL for applied rows and harmless repeats."""
    available = F.coalesce(F.col("quantity_before"), F.lit(0))
    status = F.col("status")
    return (
        F.when(status == "rejected", F.lit(texts.BELOW_ZERO))
        .when(status == "product_not_found", F.format_string(texts.UNKNOWN_PRODUCT, "product_id", "store_id"))
        .when(status == "insufficient_stock", F.format_string(texts.TOO_LITTLE_STOCK, available, -F.col("delta")))
        .when(status == "duplicate_event_id", F.lit(texts.USED_EVENT_ID))
    )


def refused(ledger: DataFrame) -> DataFrame:
    """Everything that was neither applied nor a harmless repeat, with the reason text."""
    return ledger.where(~F.col("status").isin("applied", "duplicate")).withColumn("reason", refusal_reason())


def duplicates(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("status") == "duplicate")


def audit_rows(ledger: DataFrame, changed_at: Column, sequence: Column | None = None) -> DataFrame:
    """K6: one history row per applied movement. ``changed_at`` is the processing time.

    ``sequence`` grows with the order of arrival; it tells apart changes that were processed at one time.
    """
    return applied(ledger).select(
        stable_id(F.lit("history"), "event_id").alias("id"),
        inventory_id("store_id", "product_id").alias("inventory_id"),
        "change_type",
        "quantity_before", "quantity_after", "quantity_delta",
        F.col("event_id").alias("source_event_id"),
        changed_at.alias("changed_at"),
        *([] if sequence is None else [sequence.cast("long").alias("sequence")]),
    )


def balances_after(ledger: DataFrame, balances: DataFrame | None = None) -> DataFrame:
    """K7: balances once the ledger is applied. Applied deltas add up, so this is a plain hash aggregate."""
    moves = applied(ledger).select(*PAIR, F.col("quantity_delta").alias("quantity"))
    if balances is not None:
        moves = moves.unionByName(balances.select(*PAIR, F.col("quantity").cast("long").alias("quantity")))
    return moves.groupBy(*PAIR).agg(F.sum("quantity").alias("quantity"))


def split_processed(events: DataFrame, processed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K3: (fresh, already processed) by event id."""
    ids = processed.select("event_id")
    return events.join(ids, "event_id", "left_anti"), events.join(ids, "event_id", "left_semi")


def processed_rows(
    events: DataFrame, *, order: Sequence[str], processed_at: Column, processed: DataFrame | None = None
) -> DataFrame:
    """First write per event id wins; ids already stored are skipped."""
    if processed is not None:
        events = events.join(processed.select("event_id"), "event_id", "left_anti")
    first = events.groupBy("event_id").agg(
        F.min_by(F.struct(*PAIR, processed_at.alias("processed_at")), F.struct(*order)).alias("first"))
    return first.select(
        stable_id(F.lit("processed"), "event_id").alias("id"), "event_id", "first.product_id", "first.store_id",
        F.lit("processed").alias("status"), "first.processed_at")
