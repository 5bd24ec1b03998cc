"""Parquet tables: reads, date-partitioned appends, and replay-safe writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.schemas import TABLES

# Tables that grow with events are partitioned by the day of this column.
TIME_COLUMN = {
    "inventory_history": "changed_at",
    "sales": "sold_at",
    "anomalies": "detected_at",
    "alerts": "triggered_at",
    "processed_events": "processed_at",
    "failed_events": "failed_at",
    "reconciliation_records": "reconciled_at",
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one of the domain tables with its fixed schema, keeping the day column for partition pruning."""
    schema = TABLES[name]
    if name in TIME_COLUMN:
        schema = schema.__class__([*schema.fields]).add("day", "date")
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def append_table(frame: DataFrame, root: str, name: str) -> None:
    """Append rows; growing tables land in one folder per day.

    Rows are clustered by day before the write, so a task writes few days, and AQE splits a day that is too big
    for one task instead of funnelling it through a single writer.
    """
    columns = TABLES[name].fieldNames()
    rows = frame.select(*[F.col(c).cast(TABLES[name][c].dataType).alias(c) for c in columns])
    if name not in TIME_COLUMN:
        rows.write.mode("append").parquet(f"{root}/{name}")
        return
    rows = rows.withColumn("day", F.to_date(TIME_COLUMN[name])).hint("rebalance", F.col("day"))
    rows.write.mode("append").partitionBy("day").parquet(f"{root}/{name}")


def recent(frame: DataFrame, column: str, since) -> DataFrame:
    """Rows at or after ``since``; the day condition prunes partitions when the table has them."""
    rows = frame.where(F.col(column) >= since)
    if "day" in frame.columns:
        rows = rows.where(F.col("day") >= F.to_date(since))
    return rows
