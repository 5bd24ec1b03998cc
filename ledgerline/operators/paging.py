"""Listing filters, pages and point lookups: F9-F12, T1, T4, A7."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import all_of
from ledgerline.session import cut_lineage

DEFAULT_LIMIT, MAX_LIMIT = 20, 100
# Up to here a page is a top-k; further in, a distributed sort with row positions is cheaper and safer.
TOP_K_REACH = 50_000


def matching(frame: DataFrame, **wanted) -> DataFrame:
    """AND of the given equalities; empty values mean no condition."""
    conditions = [F.col(n) == v for n, v in wanted.items() if isinstance(v, Column) or v]
    return frame.where(all_of(conditions))


def by_id(frame: DataFrame, identifier: str) -> DataFrame:
    """the row with this id; an empty result means not found."""
    return frame.where(F.col("id") == identifier)


def check_page(skip: int, limit: int) -> None:
    if skip < 0 or not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"skip must be >= 0 and limit between 1 and {MAX_LIMIT}")


def page(frame: DataFrame, newest_by: str, skip: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Newest first; the id breaks ties so that pages never overlap."""
    check_page(skip, limit)
    order = [F.desc(newest_by), F.asc("id")]
    if skip + limit <= TOP_K_REACH:
        return frame.orderBy(*order).offset(skip).limit(limit)
    placed = positions(frame, order)
    return placed.where(F.col("position").between(skip, skip + limit - 1)).drop("position").orderBy(*order)


def page_with_total(frame: DataFrame, newest_by: str, skip: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """T4: the page, and on every line the number of all matching rows, of rows on the page, skip and limit.

    A page without rows is one line with these numbers and nothing else.
    """
    rows = page(frame, newest_by, skip, limit)
    total = frame.agg(F.count(F.lit(1)).alias("total"))
    # At most ``limit`` rows joined to one row.
    joined = total.join(F.broadcast(rows), F.lit(True), "left")
    counted = joined.withColumns({
        "count": F.count("id").over(Window.partitionBy("total")), "skip": F.lit(skip), "limit": F.lit(limit)})
    return counted.select(*frame.columns, "total", "count", "skip", "limit").orderBy(F.desc(newest_by), F.asc("id"))


def positions(frame: DataFrame, order: Sequence) -> DataFrame:
    """Zero-based position of every row in a total order, without bringing the rows to one task.

    The rows are range-sorted and fixed; each partition then only needs the number of rows before it, which is a
    running sum over one number per partition.
    """
    fixed = cut_lineage(frame.repartitionByRange(*order).sortWithinPartitions(*order))
    numbered = fixed.withColumn("_number", F.monotonically_increasing_id())
    numbered = numbered.withColumns({
        "_part": F.shiftright("_number", 33), "_row": F.col("_number").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = {r["_part"]: r["count"] for r in numbered.groupBy("_part").count().collect()}
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    starts = frame.sparkSession.createDataFrame(offsets, "_part long, _start long")
    # One row per partition of the sort.
    return (
        numbered.join(F.broadcast(starts), "_part")
        .withColumn("position", F.col("_start") + F.col("_row"))
        .drop("_number", "_part", "_row", "_start")
    )


def anomalies_of(anomalies: DataFrame, inventory_id: str | Column, status: str | None = None) -> DataFrame:
    """anomalies of one inventory row, newest first."""
    return matching(anomalies, inventory_id=inventory_id, status=status).orderBy(F.desc("detected_at"), "id")
