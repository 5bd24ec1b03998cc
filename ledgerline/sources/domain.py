"""The shared sample tables seen as stock-keeping data.

``events`` become stock events and ``lineitem`` becomes sales, so that every query has real input whose size
follows the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import use_utc

EVENT_ORDER = ("ts", "event_no")
SALE_ORDER = ("sold_at", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def numbered_uuid(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), 12, "0"))


def stock_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    units = (
        F.when(kind == "signup", F.ceil(value))
        .when(kind == "click", F.ceil(value / 4))
        .when(kind == "purchase", F.ceil(value))
        .when(kind == "view", F.ceil(value / 2))
        .otherwise(F.when(F.col("event_id") % 2 == 0, F.ceil(value / 10)).otherwise(-F.ceil(value / 10)))
    )
    operation = (
        F.when(kind == "signup", "RESTOCK").when(kind == "click", "RETURN")
        .when(kind.isin("purchase", "view"), "SALE").otherwise("MANUAL_ADJUSTMENT")
    )
    return read(spark, sf_dir, "events").select(
        numbered_uuid("00000000-0000-4000-8000-", F.col("event_id")).alias("event_id"),
        F.concat(F.lit("SKU-"), F.col("user_id").cast("string")).alias("product_id"),
        F.concat(F.lit("STORE-"), (F.col("user_id") % 7).cast("string")).alias("store_id"),
        operation.alias("operation"),
        units.cast("int").alias("quantity"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("event_no"),
    )


def sales_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as sales; ids repeat in the data, which exercises idempotency. Prices come from ``part``."""
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag",
        "l_shipdate")
    prices = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").cast("decimal(12,2)").alias("list_price"))
    priced = lines.join(prices, "l_partkey", "left")
    identity = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return priced.select(
        F.concat_ws("-", F.lit("line"), *[F.col(c).cast("string") for c in parts],
                    F.col("l_quantity").cast("int").cast("string"),
                    F.unix_date(F.col("l_shipdate").cast("date")).cast("string")).alias("event_id"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("sale_id"),
        F.concat(F.lit("SKU-"), (F.col("l_orderkey") % 2000).cast("string")).alias("product_id"),
        F.concat(F.lit("STORE-"), (F.col("l_orderkey") % 5).cast("string")).alias("store_id"),
        F.col("l_quantity").cast("int").alias("quantity_sold"),
        F.when(F.col("l_returnflag") != "A", F.col("list_price")).alias("sale_price"),
        F.col("l_shipdate").cast("timestamp").alias("sold_at"),
        *identity,
    )


def opening_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """400 units per pair that sells, except every tenth product, which the stock does not know."""
    order = F.col("l_orderkey")
    return (
        read(spark, sf_dir, "lineitem").where(order % 2000 % 10 != 0)
        .select(F.concat(F.lit("SKU-"), (order % 2000).cast("string")).alias("product_id"),
                F.concat(F.lit("STORE-"), (order % 5).cast("string")).alias("store_id"))
        .distinct().withColumn("quantity", F.lit(400).cast("long"))
    )


def inventory_table(balances: DataFrame, as_of: Column) -> DataFrame:
    """Balances in the shape of the inventory table."""
    from ledgerline.functions.columns import inventory_id

    return balances.select(
        inventory_id("store_id", "product_id").alias("id"), F.col("product_id").alias("sku"),
        F.col("store_id").alias("warehouse_id"), F.col("quantity").cast("long").alias("quantity"),
        F.lit(0).alias("reorder_level"), F.lit(True).alias("is_active"),
        as_of.alias("created_at"), as_of.alias("updated_at"))
