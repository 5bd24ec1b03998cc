"""Aggregates over a trailing time window, for every row of a table (J4, J5, A12, A13 per event).

For a row at time t the window is [t - lookback, t], both ends included. The time line of each key is cut into slots as
long as that window, so a window is the end of one slot and the beginning of the next. Within a slot both are running
frames, one forward and one backward, which cost a row each however many rows a window holds. Count, sum and maximum
of the two parts combine exactly, and a key is spread over as many tasks as it has slots.

A slot may be filled very unevenly. Where one holds more than ``hot_rows`` rows, the two frames over it are running
aggregates that are dealt out by ranges of rows (:mod:`ledgerline.operators.running`), so a burst costs what its rows
cost, wherever it lies and however short it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.ordered_fold import HOT_ROWS
from ledgerline.operators.running import running_stats
from ledgerline.session import cut_lineage

STATS = ("window_count", "window_sum", "window_max")


def trailing_stats(
    rows: DataFrame,
    *,
    key: Sequence[str],
    at: str,
    value: str,
    lookback_micros: int,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add count, sum and maximum of ``value`` over the trailing window of each row.

    ``at`` is in microseconds. Rows with a NULL value are looked at but not counted, which makes them pure
    triggers. Repeated rows are answered each.
    """
    slots = rows.groupBy(*key, _slot(F.col(at), lookback_micros + 1).alias("_slot")).count()
    # At most total rows / hot_rows keys.
    heavy = slots.where(F.col("count") > hot_rows).select(*key).distinct().collect()
    if not heavy:
        return _two_slots(rows, key, at, value, lookback_micros)
    names = F.broadcast(rows.sparkSession.createDataFrame(
        [tuple(r[k] for k in key) for r in heavy], T.StructType([rows.schema[k] for k in key])))
    cold = rows.join(names, list(key), "left_anti")
    hot = cut_lineage(rows.join(names, list(key), "left_semi"))
    names = [*rows.columns, *STATS]
    return _two_slots(cold, key, at, value, lookback_micros).select(*names).unionByName(
        _split_slots(hot, key, at, value, lookback_micros, hot_rows).select(*names))


def _measures(value: Column) -> dict[str, Column]:
    return {"count": F.count(value), "sum": F.sum(value), "max": F.max(value)}


def _two_slots(rows: DataFrame, key: Sequence[str], at: str, value: str, lookback: int) -> DataFrame:
    """Every row once as a fact in its slot, and once as a question to the slot before: what lies at or after its start?"""
    slot = _slot(F.col(at), lookback + 1)
    up_to_now = Window.partitionBy(*key, "_slot").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    heads = rows.withColumn("_slot", slot)
    heads = heads.withColumns({f"_head_{n}": m.over(up_to_now) for n, m in _measures(F.col(value)).items()})
    facts = rows.select(*key, slot.alias("_slot"), F.col(at).alias("_from"), F.col(value).alias("_value"))
    carried = F.struct(*[c for c in heads.columns if c != "_slot"]).alias("_row")
    asks = heads.select(*key, (F.col("_slot") - 1).alias("_slot"), (F.col(at) - lookback).alias("_from"), carried)
    onward = Window.partitionBy(*key, "_slot").orderBy(F.desc("_from")).rangeBetween(Window.unboundedPreceding, 0)
    answered = (facts.unionByName(asks, allowMissingColumns=True)
                .withColumns({f"_tail_{n}": m.over(onward) for n, m in _measures(F.col("_value")).items()})
                .where(F.col("_row").isNotNull()))
    return _together(answered, rows.columns)


def _split_slots(rows: DataFrame, key: Sequence[str], at: str, value: str, lookback: int, hot_rows: int) -> DataFrame:
    """The same two parts, each a running aggregate that is split where a slot is too large for a task."""
    slot = _slot(F.col(at), lookback + 1)
    heads = running_stats(
        rows.withColumn("_slot", slot), key=[*key, "_slot"], order=[at], hot_rows=hot_rows,
        measures={f"_head_{n}": (n, value) for n in ("count", "sum", "max")})
    carried = F.struct(*[c for c in heads.columns if c != "_slot"]).alias("_row")
    facts = rows.select(*key, slot.alias("_slot"), (-F.col(at)).alias("_back"), F.col(value).alias("_value"))
    asks = heads.select(*key, (F.col("_slot") - 1).alias("_slot"), (lookback - F.col(at)).alias("_back"), carried)
    both = cut_lineage(facts.unionByName(asks, allowMissingColumns=True))
    tails = running_stats(both, key=[*key, "_slot"], order=["_back"], hot_rows=hot_rows,
                          measures={f"_tail_{n}": (n, "_value") for n in ("count", "sum", "max")})
    return _together(tails.where(F.col("_row").isNotNull()), rows.columns)


def _together(answered: DataFrame, columns: Sequence[str]) -> DataFrame:
    parts = {n: [F.col(f"_row._head_{n}"), F.col(f"_tail_{n}")] for n in ("count", "sum", "max")}
    head, tail = parts["sum"]
    return answered.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in columns],
        sum(parts["count"][1:], parts["count"][0]).alias("window_count"),
        F.coalesce(head + tail, head, tail).alias("window_sum"), F.greatest(*parts["max"]).alias("window_max"))


def _slot(micros: Column, width: int) -> Column:
    # Whole-number division; times before the epoch round down as well.
    return ((micros - F.pmod(micros, F.lit(width))) / F.lit(width)).cast("long")
