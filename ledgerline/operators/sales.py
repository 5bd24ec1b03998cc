"""Sale posting and sales queries: K4, K5, A1, J3, T3."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import inventory_id, stable_id
from ledgerline.operators.balance import PAIR, applied, duplicates, fold_movements
from ledgerline.operators.ordered_fold import HOT_ROWS
from ledgerline.operators.running import running_stats
from ledgerline.session import cut_lineage


def sale_movements(sales_events: DataFrame) -> DataFrame:
    """Validated sales as movements that need an existing product."""
    return sales_events.withColumns({
        "delta": -F.col("quantity_sold").cast("long"),
        "change_type": F.lit("sale"),
        "must_exist": F.lit(True),
    })


def post_sales(
    sales_events: DataFrame,
    *,
    order: Sequence[str],
    balances: DataFrame,
    sales: DataFrame | None = None,
    history: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """K4. Checks, in order: sale id already posted, product known, stock sufficient, event id already used.

    ``balances`` decides which products exist. ``sales`` and ``history`` hold what earlier runs posted.
    """
    used = {}
    if sales is not None:
        used["sale_id"] = sales.select(F.col("external_sale_id").alias("sale_id")).where("sale_id is not null")
    if history is not None:
        used["event_id"] = history.select(F.col("source_event_id").alias("event_id")).where("event_id is not null")
    return fold_movements(sale_movements(sales_events), order=order, balances=balances, used_ids=used,
                          hot_rows=hot_rows)


def sales_rows(ledger: DataFrame, sold_at: Column, sequence: Column | None = None) -> DataFrame:
    """Posted sales in table shape; ``sequence`` grows with the order of arrival."""
    return applied(ledger).select(
        stable_id(F.lit("sale"), "sale_id").alias("id"),
        inventory_id("store_id", "product_id").alias("inventory_id"),
        F.col("quantity_sold").cast("int").alias("quantity_sold"),
        F.col("sale_price").cast("decimal(12,2)").alias("sale_price"),
        F.col("sale_id").alias("external_sale_id"),
        sold_at.alias("sold_at"),
        *([] if sequence is None else [sequence.cast("long").alias("sequence")]),
    )


def duplicate_sales(ledger: DataFrame, sales: DataFrame | None = None) -> DataFrame:
    """K5: a repeated sale answers with the quantity, price and record of the sale posted first.

    Without ``sales`` of earlier runs the repeats and what they repeat are rows of the one ledger, which is folded once.
    """
    if sales is None:
        answered = ledger.where(F.col("status").isin("applied", "duplicate") & F.col("sale_id").isNotNull())
        posted = F.when(F.col("status") == "applied", F.struct(
            F.col("quantity_sold").cast("int").alias("quantity"),
            F.col("sale_price").cast("decimal(12,2)").alias("price")))
        first = F.max(posted).over(Window.partitionBy("sale_id"))
        repeats = duplicates(answered.withColumn("_first", first).where("_first IS NOT NULL"))
        return repeats.select(
            "sale_id", *[c for c in ledger.columns if c != "sale_id"],
            F.col("_first.quantity").alias("original_quantity"), F.col("_first.price").alias("original_price"),
            stable_id(F.lit("sale"), "sale_id").alias("sales_record_id"))
    posted = applied(ledger).select(
        "sale_id",
        F.col("quantity_sold").cast("int").alias("original_quantity"),
        F.col("sale_price").cast("decimal(12,2)").alias("original_price"),
        stable_id(F.lit("sale"), "sale_id").alias("sales_record_id"),
    )
    if sales is not None:
        posted = posted.unionByName(sales.where("external_sale_id is not null").select(
            F.col("external_sale_id").alias("sale_id"), F.col("quantity_sold").alias("original_quantity"),
            F.col("sale_price").alias("original_price"), F.col("id").alias("sales_record_id")))
    # One posted row per sale id; a heavily repeated id only skews the left side, which AQE splits.
    return duplicates(ledger).join(posted, "sale_id")


def sales_summary(inventory: DataFrame, sales: DataFrame) -> DataFrame:
    """A1: totals per stocked pair. Revenue covers priced sales only and is NULL when there are none.

    The individual sales are a second relation (:func:`sales_items`): nesting them would put all sales of a
    best-selling product into one row.
    """
    totals = sales.groupBy("inventory_id").agg(
        F.sum(F.col("quantity_sold").cast("long")).alias("total_quantity_sold"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum(F.col("sale_price") * F.col("quantity_sold")).alias("total_revenue"),
    )
    return (
        inventory.select(F.col("id").alias("inventory_id"), F.col("sku").alias("product_id"),
                         F.col("warehouse_id").alias("store_id"))
        .join(totals, "inventory_id", "left")
        .select("product_id", "store_id",
                F.coalesce("total_quantity_sold", F.lit(0)).alias("total_quantity_sold"),
                F.coalesce("transaction_count", F.lit(0)).alias("transaction_count"),
                F.col("total_revenue").cast("decimal(38,2)").alias("total_revenue"))
    )


def sales_items(inventory: DataFrame, sales: DataFrame, *, newest_first: bool = False) -> DataFrame:
    """The sales behind each summary row, optionally sorted newest first within each pair."""
    items = sales.join(
        inventory.select(F.col("id").alias("inventory_id"), F.col("sku").alias("product_id"),
                         F.col("warehouse_id").alias("store_id")), "inventory_id")
    items = items.select("product_id", "store_id", "id", "inventory_id", "quantity_sold", "sale_price",
                         "external_sale_id", "sold_at")
    return items.orderBy(*PAIR, F.desc("sold_at"), "id") if newest_first else items


def newest_first(items: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every item with its ``place`` in its pair's listing, from 1; a pair with very many sales takes several tasks."""
    dated = cut_lineage(items.withColumn("_age", -F.unix_micros("sold_at")))
    return running_stats(dated, key=PAIR, order=["_age", "id"], measures={"place": ("count", "id")},
                         hot_rows=hot_rows).drop("_age")


def sales_of(inventory: DataFrame, sales: DataFrame, product_id: str, store_id: str) -> tuple[DataFrame, DataFrame]:
    """Summary row and newest-first sales of one pair; both empty when the pair is unknown."""
    pair = inventory.where((F.col("sku") == product_id) & (F.col("warehouse_id") == store_id))
    return sales_summary(pair, sales), sales_items(pair, sales, newest_first=True)
