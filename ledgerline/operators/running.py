"""Running aggregates per key, whole histories at a time, with hot keys spread over many tasks.

A window partitioned by a key alone puts all rows of the key into one task. Here the rows of a hot key are dealt out by
ranges of their order (slots), so a slot is as large as a task should be, whatever the key holds. Inside a slot a running
frame does the work; each slot's total is one row, and a running frame over those carries the totals of earlier slots in.
Counts, sums and maxima of the two parts combine exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.ordered_fold import HOT_ROWS
from ledgerline.session import cut_lineage

#: How a measure is taken from rows, and how those of consecutive stretches combine.
KINDS = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "max": (F.max, F.max), "min": (F.min, F.min)}


def running_stats(
    rows: DataFrame,
    *,
    key: Sequence[str],
    order: Sequence[str],
    measures: dict[str, tuple[str, str]],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add, for every row, each measure over the rows of its key up to it in ``order``, itself and its ties included.

    ``measures`` maps a new column to a kind (``count``, ``sum``, ``max`` or ``min``) and the column it is taken from.
    NULL values are not counted, so rows that only ask carry NULL. NULLs come first in the order. A row's neighbours
    of equal order are never parted, so only rows that tie can make a slot larger than ``hot_rows`` asks for.
    """
    named = [*rows.columns, *measures]
    heavy = rows.groupBy(*key).count().where(F.col("count") > hot_rows).collect()
    if not heavy:
        return _running(rows, key, order, measures).select(*named)
    # At most total rows / hot_rows keys.
    names = F.broadcast(rows.sparkSession.createDataFrame(
        [tuple(r[k] for k in key) for r in heavy],
        T.StructType([T.StructField(f"_hot_{k}", rows.schema[k].dataType) for k in key])))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
    cold = rows.join(names, same, "left_anti")
    slots = max(2, -(-2 * sum(r["count"] for r in heavy) // hot_rows))
    return _running(cold, key, order, measures).select(*named).unionByName(
        _slotted(rows.join(names, same, "left_semi"), key, order, measures, slots).select(*named))


def _running(rows: DataFrame, key: Sequence[str], order: Sequence[str], measures: dict) -> DataFrame:
    # Without a frame of its own an ordered window runs from the first row to the last tie.
    so_far = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumns({n: KINDS[kind][0](F.col(c)).over(so_far) for n, (kind, c) in measures.items()})


def _slotted(rows: DataFrame, key: Sequence[str], order: Sequence[str], measures: dict, slots: int) -> DataFrame:
    # The slots are fixed before they are read twice: a range partitioning is drawn from a sample.
    placed = cut_lineage(
        rows.repartitionByRange(slots, *key, *order).withColumn("_running_slot", F.spark_partition_id()))
    totals = placed.groupBy(*key, "_running_slot").agg(*[KINDS[kind][0](F.col(c)).alias(n) for n, (kind, c) in measures.items()])
    # One row per key and slot: as many as there are slots, and one more for each key that shares a slot.
    earlier = Window.partitionBy(*key).orderBy("_running_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"_of_{k}") for k in key], F.col("_running_slot").alias("_of_running_slot"),
        *[KINDS[kind][1](F.col(n)).over(earlier).alias(f"_carried_{n}") for n, (kind, _) in measures.items()])
    same = F.col("_running_slot") == F.col("_of_running_slot")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    # Only hot keys come here, of which a table has few; ``carried`` has a row for each and for each slot.
    joined = _running(placed, [*key, "_running_slot"], order, measures).join(F.broadcast(carried), same)
    for n, (kind, _) in measures.items():
        before, here = F.col(f"_carried_{n}"), F.col(n)
        whole = {"count": F.coalesce(before, F.lit(0)) + here, "sum": F.coalesce(before + here, before, here),
                 "max": F.greatest(before, here), "min": F.least(before, here)}[kind]
        joined = joined.withColumn(n, whole)
    return joined
