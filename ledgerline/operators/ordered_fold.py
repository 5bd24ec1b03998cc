"""Ordered per-key folds whose decisions feed back into the state (K1, K2, K4, K8).

A running sum cannot express these: a refused row must not move the state. Every row is shuffled once by key,
sorted inside its partition and streamed through a kernel batch by batch. What a task holds does not grow with a key:
only ids that occur more than once among the rows reach the kernel, which remembers those of them that it applied.
Special cases are found by size checks and only paid for when they occur:

* *Hot keys* (more rows than ``hot_rows``) are range-partitioned by key **and order**, so one key spreads over
  many tasks. Each segment is folded once for all starts together and reports its end as a piecewise-linear function of
  its start. One streamed task per key then follows these functions from the opening state, holding one at a time, and
  so finds the true start of every segment; a second pass folds the segments from there. That is two passes whatever
  the data and the number of segments, and nothing of it on the driver.
* *Contested ids* are ids found in more than one key or segment. Whether an id is used up depends on rows
  elsewhere. Keys that share contested ids, directly or by way of others, make a group, and a group is folded in one
  pass over all its keys in order. Only groups that are too large for a task, or hold a hot key, are settled by
  repeating the fold over their keys until the first applied occurrence of every such id no longer changes.

``order`` must be a total order. Two rows of a key at the same place in it fail the job; rows of different keys at the
same place are taken in the order of their keys.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators import kernels
from ledgerline.operators.components import components
from ledgerline.session import cut_lineage

# The task functions travel with the plan, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(kernels)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HOT_ROWS = 2_000_000
# A table of repeated ids of up to so many rows (some 60 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_IDS = 200_000
SEGMENT, HEAD, STATE, GROUP, START, MOST = "_segment", "_head", "_state", "_group", "_start", "_most"
_COLD = -1

# A link of a key's chain: a segment that the key enters at its first row (``low``, ``end``, ``slope`` are its function
# there), or one that it begins inside of (``end`` is its one value, there is no ``low``).
# A function with very many pieces is put out in several ``parts``.
_LINKS = ("chain string, segment int, part int, opening bigint, low array<bigint>, end array<bigint>, "
          "slope array<bigint>")
_LINKS_ARROW = pa.schema([("chain", pa.string()), ("segment", pa.int32()), ("part", pa.int32()), ("opening", pa.int64()),
                          *[(name, pa.list_(pa.int64())) for name in ("low", "end", "slope")]])
# The same with bounds in place of functions: after the link a state is at most ``max(before + add, floor)``.
_BOUNDS = "chain string, segment int, enters boolean, opening bigint, add bigint, floor bigint"
_BOUNDS_ARROW = pa.schema([("chain", pa.string()), ("segment", pa.int32()), ("enters", pa.bool_()),
                           *[(name, pa.int64()) for name in ("opening", "add", "floor")]])


def ordered_fold(
    rows: DataFrame,
    kernel,
    *,
    key: Sequence[str],
    order: Sequence[str],
    openings: DataFrame | None = None,
    used_ids: dict[str, DataFrame] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Fold ``rows`` per ``key`` in ``order`` and return them with the kernel's output columns.

    ``order`` must be a total order, because ids are compared across keys. ``openings`` holds one
    row per known key with its starting state in ``_state``. ``used_ids`` names, per id column, the ids already
    applied by earlier runs.
    """
    fold = _Fold(kernel, tuple(key), tuple(order), openings, hot_rows)
    heavy = fold.heavy(rows)
    rows = fold.mark_used(rows, used_ids or {})
    repeated = fold.repeated(rows)
    if not heavy and not any(repeated.values()):
        results = [fold.run_cold(rows, repeated=list(repeated))]
    else:
        cold, hot = fold.split(fold.mark_repeated(rows), heavy)
        results = fold.settle_ids(cold, hot)
        if results is None:
            results = [fold.run_cold(cold)] + ([fold.run_hot(hot)] if hot is not None else [])
    plumbing = [SEGMENT, HEAD, STATE, GROUP, START, *[f"{kind}_{c}" for c in kernel.ids for kind in ("_blocked", "_again")]]
    return reduce(DataFrame.unionByName, [r.drop(*plumbing) for r in results])


class _Fold:
    def __init__(self, kernel, key: tuple[str, ...], order: tuple[str, ...], openings: DataFrame | None,
                 hot_rows: int) -> None:
        self.kernel = kernel
        self.key = key
        self.order = order
        self.hot_rows = hot_rows
        self.openings = None if openings is None else openings.select(*key, F.col(STATE).cast("long").alias(STATE))

    # -- preparation -----------------------------------------------------------------------------------------

    def mark_used(self, rows: DataFrame, used: dict[str, DataFrame]) -> DataFrame:
        for column in self._ids(rows):
            if column in used:
                flag = f"_blocked_{column}"
                ids = used[column].select(column).distinct().withColumn(flag, F.lit(True))
                rows = rows.join(ids, column, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
        return rows

    def _ids(self, rows: DataFrame) -> list[str]:
        return [c for c in self.kernel.ids if c in rows.columns]

    def repeated(self, rows: DataFrame) -> dict[str, bool]:
        """The id columns in which ids occur more than once, and whether one of them does so in several keys.

        Ids are told apart by digests here: equal digests of unequal ids only make the fold look closer.
        """
        ids = self._ids(rows)
        if not ids:
            return {}
        uses = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.xxhash64(c).alias("digest"),
                                           F.col(c).isNotNull().alias("known")) for c in ids]))
        keys, ends = self._spread(*self.key)
        found = (
            rows.select(uses, *keys).where("known").groupBy("column", "digest")
            .agg(F.count(F.lit(1)).alias("uses"), *ends).where("uses > 1")
            .groupBy("column").agg(F.max(self._several()).alias("contested")))
        return {r["column"]: r["contested"] for r in found.collect()}

    def mark_repeated(self, rows: DataFrame) -> DataFrame:
        """``_again_<id>``: the id where it occurs more than once among the rows, NULL elsewhere."""
        ids = self._ids(rows)
        if not ids:
            return rows
        # All id columns in one aggregate.
        pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("id")) for c in ids]))
        again = cut_lineage(rows.select(pairs).where("id IS NOT NULL").groupBy("column", "id").count().where("count > 1"))
        many = {r["column"]: r["ids"] for r in again.groupBy("column").agg(F.count(F.lit(1)).alias("ids")).collect()}
        for column in many:
            marked = again.where(F.col("column") == column).select(F.col("id").alias(f"_again_{column}"))
            marked = F.broadcast(marked) if many[column] <= BROADCAST_IDS else marked
            rows = rows.join(marked, F.col(column) == F.col(f"_again_{column}"), "left")
        return rows

    def heavy(self, rows: DataFrame) -> list:
        """The keys that are too large for one task, with their sizes: at most total / hot_rows of them."""
        return rows.groupBy(*self.key).count().where(F.col("count") > self.hot_rows).collect()

    def split(self, rows: DataFrame, heavy: list) -> tuple[DataFrame, DataFrame | None]:
        if not heavy:
            return rows, None
        names = F.broadcast(rows.sparkSession.createDataFrame(
            [tuple(r[k] for k in self.key) for r in heavy],
            T.StructType([rows.schema[k] for k in self.key])))
        width = max(2, -(-2 * sum(r["count"] for r in heavy) // self.hot_rows))
        hot = (
            rows.join(names, list(self.key), "left_semi")
            .repartitionByRange(width, *self.key, *self.order)
            .sortWithinPartitions(*self.key, *self.order)
            .withColumn(SEGMENT, F.spark_partition_id())
        )
        # Range bounds come from a sample, so the segments must be fixed before they are summarised and reused.
        return rows.join(names, list(self.key), "left_anti"), cut_lineage(hot)

    # -- opening states --------------------------------------------------------------------------------------

    def _framed(self, rows: DataFrame, of_these_keys: bool = False) -> DataFrame:
        """Rows together with the opening state rows, told apart by ``_head``."""
        if self.openings is None:
            return rows
        framed = rows.withColumn(HEAD, F.lit(False)).withColumn(STATE, F.lit(None).cast("long"))
        openings = self.openings
        if of_these_keys:
            openings = openings.join(rows.select(*self.key).distinct(), list(self.key), "left_semi")
        return framed.unionByName(openings.withColumn(HEAD, F.lit(True)), allowMissingColumns=True)

    @staticmethod
    def _heads_first(framed: DataFrame) -> list[Column]:
        return [F.desc(HEAD)] if HEAD in framed.columns else []

    # -- cold keys: one shuffle, one streaming pass ----------------------------------------------------------

    def run_cold(self, rows: DataFrame, of_these_keys: bool = False, repeated: Sequence[str] = ()) -> DataFrame:
        """``repeated`` names id columns that are not marked yet and whose ids each belong to one key."""
        framed = self._framed(rows, of_these_keys)
        placed = framed.repartition(*self.key)
        for column in repeated:
            # The rows of a key are in one place already. The digest comes first because numbers sort fast.
            same = Window.partitionBy(F.xxhash64(*self.key, column), *self.key, column)
            placed = placed.withColumn(f"_again_{column}", F.when(F.count(column).over(same) > 1, F.col(column)))
        schema = self._result_schema(placed)
        placed = placed.sortWithinPartitions(*self.key, *self._heads_first(framed), *self.order)
        return placed.mapInArrow(_cold_task(self.kernel, self.key, self.order, schema.fieldNames()), schema)

    def run_groups(self, rows: DataFrame, groups: DataFrame) -> DataFrame:
        """Rows of keys that share ids, in one pass per group (key, ``_group``): the keys of a group share what they use up."""
        schema = self._result_schema(rows)
        framed = self._framed(rows, of_these_keys=True).join(groups, list(self.key))
        placed = framed.repartition(GROUP).sortWithinPartitions(
            GROUP, *self._heads_first(framed), *self.order, *self.key)
        return placed.mapInArrow(_group_task(self.kernel, self.key, self.order, schema.fieldNames()), schema)

    # -- hot keys: segments, summaries, exact starts ---------------------------------------------------------

    def run_hot(self, segments: DataFrame) -> DataFrame:
        schema = self._result_schema(segments)
        opened = self._hot_openings(segments)
        # One row per segment. Broadcast joins leave rows where they are and in order.
        starts = F.broadcast(cut_lineage(self._find_starts(opened)))
        return opened.join(starts, SEGMENT).mapInArrow(
            _segment_task(self.kernel, self.key, self.order, schema.fieldNames()), schema)

    def _hot_openings(self, segments: DataFrame) -> DataFrame:
        """``segments`` with the opening state of their key."""
        if self.openings is None:
            return segments.withColumn(STATE, F.lit(None).cast("long"))
        # At most as many keys as ``heavy`` found.
        keys = F.broadcast(segments.select(*self.key).distinct())
        return segments.join(F.broadcast(self.openings.join(keys, list(self.key), "left_semi")), list(self.key), "left")

    def _find_starts(self, segments: DataFrame) -> DataFrame:
        """(segment, start): the state with which the first key of each segment enters it."""
        needed = dict.fromkeys([*self.key, *self.kernel.inputs, SEGMENT, STATE])
        slim = segments.select(*[c for c in needed if c in segments.columns])
        if self.kernel.limit() is not None:
            bounds = slim.mapInArrow(_bound_task(self.kernel, self.key), _BOUNDS)
            most = bounds.repartition("chain").sortWithinPartitions("chain", "segment").mapInArrow(
                _bound_chain_task(self.kernel), f"{SEGMENT} int, {MOST} bigint")
            slim = slim.join(F.broadcast(cut_lineage(most)), SEGMENT)
        links = slim.mapInArrow(_link_task(self.kernel, self.key), _LINKS)
        chains = links.repartition("chain").sortWithinPartitions("chain", "segment", "part")
        return chains.mapInArrow(_chain_task(self.kernel), f"{SEGMENT} int, {START} bigint")

    # -- ids that more than one key or segment may use up ----------------------------------------------------

    def settle_ids(self, cold: DataFrame, hot: DataFrame | None) -> list[DataFrame] | None:
        ids = [c for c in self.kernel.ids if f"_again_{c}" in cold.columns]
        if not ids:
            return None
        everything = cold.withColumn(SEGMENT, F.lit(_COLD))
        if hot is not None:
            everything = everything.unionByName(hot)
        # Only rows with a repeated id are looked at.
        marked = reduce(Column.__or__, [F.col(f"_again_{column}").isNotNull() for column in ids])
        looked_at = cut_lineage(everything.where(marked).select(
            *dict.fromkeys([*self.key, *self.order, SEGMENT, *[f"_again_{column}" for column in ids]])))
        uses = {column: looked_at.where(F.col(f"_again_{column}").isNotNull())
                .withColumn(column, F.col(f"_again_{column}")) for column in ids}
        contested = {column: cut_lineage(self._contested(rows, column)) for column, rows in uses.items()}
        contested = {column: found for column, found in contested.items() if not found.isEmpty()}
        if not contested:
            return None
        groups = self._groups({column: uses[column].join(found, column, "left_semi")
                               for column, found in contested.items()})
        counts = everything.groupBy(*self.key).agg(F.count(F.lit(1)).alias("rows"), F.max(SEGMENT).alias("segment"))
        sizes = counts.join(groups, list(self.key)).groupBy(GROUP).agg(
            F.sum("rows").alias("rows"), F.max("segment").alias("segment"))
        fits = (F.col("rows") <= self.hot_rows) & (F.col("segment") == _COLD)
        sized = cut_lineage(groups.join(sizes.select(GROUP, fits.alias("fits")), GROUP))
        small = sized.where("fits").drop("fits")
        rest = sized.where("NOT fits").select(*self.key)
        done = [] if small.isEmpty() else [self.run_groups(cold, small)]
        cold = cold.join(small.select(*self.key), list(self.key), "left_anti")
        if rest.isEmpty():
            return [self.run_cold(cold), *done] + ([] if hot is None else [self.run_hot(hot)])
        first, hot = self._repeat(cold.join(rest, list(self.key), "left_semi"), hot, looked_at, contested)
        return [self.run_cold(self._flag(cold, first)), *done] + ([] if hot is None else [hot])

    def _groups(self, uses: dict[str, DataFrame]) -> DataFrame:
        """(key, ``_group``) of all keys that contested ids connect; ``uses`` are the rows that carry such ids."""
        node = F.to_json(F.struct(*self.key), {"ignoreNullFields": "false"})
        pairs = reduce(DataFrame.unionByName, [
            rows.select(F.lit(column).alias("column"), F.col(column).alias("id"), *self.key, node.alias("b")).distinct()
            for column, rows in uses.items()])
        pairs = cut_lineage(pairs)
        hubs = pairs.groupBy("column", "id").agg(F.min("b").alias("a"))
        joined = components(pairs.join(hubs, ["column", "id"]).select("a", "b"))
        keys = pairs.select(*self.key, "b").distinct()
        # A key may hold all contested uses of its ids in several segments; it is a group of its own then.
        return cut_lineage(keys.join(joined, F.col("b") == F.col("node"), "left").select(
            *self.key, F.coalesce("component", "b").alias(GROUP)))

    def _repeat(self, involved: DataFrame, hot: DataFrame | None, looked_at: DataFrame,
                contested: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame | None]:
        """The first applied use of every contested id, and the hot rows folded with them.

        The rounds read only what the kernel needs, kept once, and report only the uses that were applied.
        """
        first = {column: cut_lineage(self._first_use(looked_at, contested[column], column)) for column in contested}
        needed = dict.fromkeys([*self.key, *self.order, *self.kernel.inputs])
        slim = cut_lineage(involved.select(*[c for c in needed if c in involved.columns]))
        reported = reduce(Column.__or__, [F.col(f"_again_{column}").isNotNull() for column in contested])
        while True:
            outcome = [self.run_cold(self._flag(slim, first), of_these_keys=True).withColumn(SEGMENT, F.lit(_COLD))]
            done = None
            if hot is not None:
                done = cut_lineage(self.run_hot(cut_lineage(self._resegment(self._flag(hot, first)))))
                outcome.append(done)
            used = [*self.key, *self.order, SEGMENT, *[f"_again_{column}" for column in contested]]
            applied = cut_lineage(reduce(DataFrame.unionByName, [
                rows.where(reported & (F.col("status") == self.kernel.accepted)).select(*dict.fromkeys(used))
                for rows in outcome]))
            again = {column: cut_lineage(self._first_use(applied, contested[column], column))
                     for column in contested}
            stable = all(self._same(first[column], again[column]) for column in contested)
            first = again
            if stable:
                return first, done

    def _unit(self) -> Column:
        return F.struct(*self.key, SEGMENT)

    @staticmethod
    def _spread(*unit: str) -> tuple[list[Column], list[Column]]:
        """Digests of a unit, and aggregates of them that show whether it varies.

        Fixed-width digests keep this a hash aggregate; two of them make 128 bits, as in the stable row ids.
        """
        digests = [F.xxhash64(F.lit(salt), *unit).alias(f"unit{salt}") for salt in (1, 2)]
        return digests, [f(f"unit{salt}").alias(f"{name}{salt}") for salt in (1, 2)
                         for f, name in ((F.min, "low"), (F.max, "high"))]

    @staticmethod
    def _several() -> Column:
        return (F.col("low1") != F.col("high1")) | (F.col("low2") != F.col("high2"))

    def _contested(self, rows: DataFrame, column: str) -> DataFrame:
        units, ends = self._spread(*self.key, SEGMENT)
        return rows.select(column, *units).groupBy(column).agg(*ends).where(self._several()).select(column)

    def _first_use(self, rows: DataFrame, contested: DataFrame, column: str) -> DataFrame:
        use = F.struct(F.struct(*self.order).alias("at"), self._unit().alias("unit"))
        return (
            rows.where(F.col(f"_again_{column}").isNotNull()).select(F.col(f"_again_{column}").alias(column), use.alias("use"))
            .join(contested, column, "left_semi")
            .groupBy(column).agg(F.min("use").alias(f"_first_{column}"))
        )

    def _flag(self, rows: DataFrame, first: dict[str, DataFrame]) -> DataFrame:
        placed = rows if SEGMENT in rows.columns else rows.withColumn(SEGMENT, F.lit(_COLD))
        for column, uses in first.items():
            use, flag = f"_first_{column}", f"_blocked_{column}"
            here = F.struct(F.struct(*self.order).alias("at"), self._unit().alias("unit"))
            taken = (F.col(use) < here) & (F.col(f"{use}.unit") != self._unit())
            blocked = F.coalesce(taken, F.lit(False))
            if flag in rows.columns:
                blocked = F.col(flag) | blocked
            else:
                placed = placed.withColumn(flag, F.lit(False))
            # Only rows with a repeated id take part in the join.
            again, uses = F.col(f"_again_{column}"), uses.withColumnRenamed(column, "_id")
            marked = placed.where(again.isNotNull()).join(uses, again == F.col("_id"), "left")
            placed = placed.where(again.isNull()).unionByName(marked.withColumn(flag, blocked).drop(use, "_id"))
        return placed

    def _resegment(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(SEGMENT).sortWithinPartitions(SEGMENT, *self.key, *self.order)

    @staticmethod
    def _same(left: DataFrame, right: DataFrame) -> bool:
        return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()

    def _result_schema(self, rows: DataFrame) -> T.StructType:
        added = [T.StructField(name, kind) for name, kind, _ in self.kernel.outputs]
        return T.StructType([*[f for f in rows.schema.fields if f.name not in (HEAD, STATE, START)], *added])


# -- tasks: each receives the sorted Arrow batches of one partition ----------------------------------------------


def _columns(batch: pa.RecordBatch, kernel) -> dict[str, np.ndarray]:
    """Kernel inputs as numpy arrays, and which rows carry ids or flags that need a look of their own.

    Inputs other than text are never null on real rows; opening rows carry nulls there and are not read.
    """
    present, found = set(batch.schema.names), {}
    for name in kernel.inputs:
        if name not in present:
            default = kernel.defaults[name]
            found[name] = np.full(batch.num_rows, default, object if default is None else type(default))
            continue
        array = batch.column(name)
        if not pa.types.is_string(array.type):
            array = pc.fill_null(array, False if pa.types.is_boolean(array.type) else 0)
        found[name] = array.to_numpy(zero_copy_only=False)
    special = np.zeros(batch.num_rows, bool)
    for name in kernel.inputs:
        if name.startswith("_again_") and name in present:
            special |= batch.column(name).is_valid().to_numpy(zero_copy_only=False)
        elif name.startswith("_blocked_") and name in present:
            special |= found[name]
    found["_special"] = special
    return found


def _heads(batch: pa.RecordBatch) -> np.ndarray:
    if HEAD not in batch.schema.names:
        return np.zeros(batch.num_rows, bool)
    return pc.fill_null(batch.column(HEAD), False).to_numpy(zero_copy_only=False)


def _without_heads(batch: pa.RecordBatch, heads: np.ndarray) -> pa.RecordBatch:
    return batch.filter(pa.array(~heads)) if heads.any() else batch


def _refuse_ties(batch: pa.RecordBatch, columns: Sequence[str], last: pa.RecordBatch | None) -> pa.RecordBatch:
    """Fail if two rows in a row have the same key and order; returns the last row, to go on with the next batch."""
    rows = batch.select(list(columns))
    tied = np.ones(max(batch.num_rows - 1, 0), bool)
    for array in rows.columns:
        same = pc.equal(array.slice(1), array.slice(0, batch.num_rows - 1))
        tied &= pc.fill_null(same, False).to_numpy(zero_copy_only=False)
    if last is not None:
        tied = np.append(tied, all(a[0].is_valid and a[0].equals(b[0]) for a, b in zip(rows.columns, last.columns)))
    if tied.any():
        at = int(tied.argmax())
        raise ValueError(f"the order is not total: two rows at {rows.slice(at if at < batch.num_rows - 1 else 0, 1).to_pylist()}")
    return rows.slice(batch.num_rows - 1, 1)


def _runs(batch: pa.RecordBatch, columns: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Bounds of the stretches of equal ``columns`` inside one sorted batch."""
    size = batch.num_rows
    if size == 0:
        return
    cuts = np.zeros(max(size - 1, 0), dtype=bool)
    for name in columns:
        values = batch.column(name)
        changed = pc.not_equal(values.slice(1), values.slice(0, size - 1))
        cuts |= pc.fill_null(changed, True).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(cuts) + 1).tolist(), size]
    yield from zip(edges, edges[1:])


def _key_at(batch: pa.RecordBatch, key: Sequence[str], position: int) -> tuple:
    return tuple(batch.column(name)[position].as_py() for name in key)


def _emit(batch: pa.RecordBatch, kernel, names: Sequence[str], out: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    arrays = dict(zip([name for name, _, _ in kernel.outputs], kernel.arrays(out)))
    return pa.RecordBatch.from_arrays(
        [arrays[name] if name in arrays else batch.column(name) for name in names], names=list(names))


def _cold_task(kernel, key: Sequence[str], order: Sequence[str], names: Sequence[str]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, run, last = None, None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            last = _refuse_ties(batch, [*key, *order], last)
            columns, heads, out = _columns(batch, kernel), _heads(batch), kernel.room(batch.num_rows)
            for low, high in _runs(batch, key):
                name = _key_at(batch, key, low)
                if name != current:
                    current, run = name, kernel.begin(batch.column(STATE)[low].as_py() if heads[low] else None)
                    while low < high and heads[low]:
                        low += 1
                run.advance(columns, low, high, out)
            yield _without_heads(_emit(batch, kernel, names, out), heads)

    return task


def _group_task(kernel, key: Sequence[str], order: Sequence[str], names: Sequence[str]):
    """All keys of a group in one order; the runs share the ids they have applied."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, runs, shared, last = None, {}, None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            last = _refuse_ties(batch, [GROUP, *order, *key], last)
            columns, heads, out = _columns(batch, kernel), _heads(batch), kernel.room(batch.num_rows)
            groups = batch.column(GROUP).to_pylist()
            states = batch.column(STATE).to_pylist() if heads.any() else None
            for i, name in enumerate(zip(*[batch.column(k).to_pylist() for k in key])):
                if groups[i] != group:
                    group, runs, shared = groups[i], {}, kernel.begin(None)
                if heads[i] or name not in runs:
                    runs[name] = kernel.begin(states[i] if heads[i] else None)
                    runs[name].share_ids(shared)
                if not heads[i]:
                    runs[name].advance(columns, i, i + 1, out)
            yield _without_heads(_emit(batch, kernel, names, out), heads)

    return task


def _segment_task(kernel, key: Sequence[str], order: Sequence[str], names: Sequence[str]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, current, run, last = None, None, None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            last = _refuse_ties(batch, [*key, *order], last)
            columns, out = _columns(batch, kernel), kernel.room(batch.num_rows)
            for low, high in _runs(batch, [SEGMENT, *key]):
                number, name = batch.column(SEGMENT)[low].as_py(), _key_at(batch, key, low)
                if number != segment:
                    run = kernel.begin(batch.column(START)[low].as_py())
                elif name != current:
                    run = kernel.begin(batch.column(STATE)[low].as_py())
                segment, current = number, name
                run.advance(columns, low, high, out)
            yield _emit(batch, kernel, names, out)

    return task


def _stretches(batches: Iterator[pa.RecordBatch], kernel, key: Sequence[str]) -> Iterator[tuple]:
    """(batch, kernel columns, low, high, segment, key, opening) of each stretch of one key in one segment."""
    for batch in batches:
        if batch.num_rows:
            columns = _columns(batch, kernel)
            for low, high in _runs(batch, [SEGMENT, *key]):
                yield (batch, columns, low, high, batch.column(SEGMENT)[low].as_py(), _key_at(batch, key, low),
                       batch.column(STATE)[low].as_py())


def _bound_task(kernel, key: Sequence[str]):
    """Each segment's bounds for its first key, and for its last key if that is another one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, links = None, []

        def bounds() -> pa.RecordBatch:
            ends = links if len(links) < 2 else [links[0], links[-1]]
            return pa.RecordBatch.from_pylist([
                {"chain": repr(name), "segment": segment, "enters": i == 0, "opening": opening, "add": limit.add,
                 "floor": limit.floor} for i, (name, opening, limit) in enumerate(ends)], schema=_BOUNDS_ARROW)

        for _, columns, low, high, number, name, opening in _stretches(batches, kernel, key):
            if number != segment and links:
                yield bounds()
                links = []
            segment = number
            if not links or links[-1][0] != name:
                # Only the first and the last key of a segment count.
                links = [*links[:1], (name, opening, kernel.limit())]
            links[-1][2].advance(columns, low, high)
        if links:
            yield bounds()

    return task


def _bound_chain_task(kernel):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, most = None, None
        for batch in batches:
            found = []
            for name, segment, enters, opening, add, floor in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if name != chain:
                    chain, most = name, kernel.absent if opening is None else opening
                if enters:
                    found.append((segment, most))
                most = max(most + add, floor)
            columns = list(zip(*found)) if found else [[], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64())], names=[SEGMENT, MOST])

    return task


def _link_task(kernel, key: Sequence[str]):
    """The links of each segment: the function of its first key, and the end of its last key if that is another one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, current, first, live, part = None, None, None, None, 0

        def link(function) -> pa.RecordBatch:
            low, end, slope = (x.tolist() for x in function.pieces())
            return pa.RecordBatch.from_pylist([{
                "chain": repr(first[0]), "segment": segment, "part": part, "opening": first[1], "low": low, "end": end,
                "slope": slope}], schema=_LINKS_ARROW)

        def last() -> Iterator[pa.RecordBatch]:
            if current == first[0]:
                yield link(live)
            else:
                yield pa.RecordBatch.from_pylist([{
                    "chain": repr(current), "segment": segment, "part": 0, "end": [live.state]}], schema=_LINKS_ARROW)

        for batch, columns, low, high, number, name, opening in _stretches(batches, kernel, key):
            if number != segment:
                if first is not None:
                    yield from last()
                most = batch.column(MOST)[low].as_py() if MOST in batch.schema.names else None
                live, part = kernel.function(most), 0
                segment, current, first = number, name, (name, opening)
            elif name != current:
                if current == first[0]:
                    yield link(live)
                current, live = name, kernel.begin(opening)
            if current != first[0]:
                live.advance(columns, low, high, None)
                continue
            for at in range(low, high, kernels.STEP):
                live.advance(columns, at, min(at + kernels.STEP, high), None)
                if live.is_full():
                    yield link(live)
                    live, part = kernel.function(live.highest()), part + 1
        if first is not None:
            yield from last()

    return task


def _chain_task(kernel):
    """Follows each key through its segments, from one function to the next."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, state = None, None
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                name, segment, part, opening = (batch.column(c)[i].as_py() for c in range(4))
                low, end, slope = (batch.column(c)[i].values for c in range(4, 7))
                if low is None:
                    chain, state = name, end[0].as_py()
                    continue
                if name != chain:
                    chain, state = name, kernel.absent if opening is None else opening
                if part == 0:
                    found.append((segment, state))
                state = kernels.end_for(*(x.to_numpy(zero_copy_only=False) for x in (low, end, slope)), state)
            columns = list(zip(*found)) if found else [[], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64())], names=[SEGMENT, START])

    return task
