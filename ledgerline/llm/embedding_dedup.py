"""Embedding near-duplicates (3): binary codes after a random rotation, with stored correction factors.

1. Equal vectors are collapsed before anything is compared (one representative, with the number of its copies).
2. Each vector is turned once by a fixed random orthogonal matrix and stored as a code: the signs of the turned
   components, three more bits of each for its part as the other side of a pair, and three numbers, of which the
   correction factor is the inner product of the turned unit vector with its vector of signs.
3. Bits of further rotations, stored with the code, are the keys of hash tables; vectors that share a key meet in a
   bucket. Buckets hold some 512 vectors, and the number of tables follows from the chance to miss a pair that lies
   exactly on the threshold (``Codes.missed``; closer pairs are missed far more rarely). Only codes are shuffled for
   each table, a fraction of a vector; there are 14 tables for 51 000 vectors, 23 for a million and 76 for 10^9, and
   the shuffle grows with them.
4. In a bucket, signs times small integers, divided by the factor, estimate each inner product. The estimate from
   signs has no bias; rounding to the integers adds a little (at cosine 0.95, -0.004 with 64 components and -0.0006
   with 384, as measured), which the bound covers. For a pair on the threshold or closer, the error is bounded with the factor at ``Codes.sigmas`` deviations, plus what the
   small integers left out. Pairs whose bound stays below the threshold, on either side, are done.
5. Only vectors of the other pairs are fetched from the stored table, and those pairs are computed again in double
   precision; only that decides. A pair is taken in the first table in which both share a key, so counts add up over
   buckets and no pair is put out: a bucket puts out a row per vector, its count and the smallest vector it is
   connected with there.
6. Buckets beyond twice ``Codes.block`` vectors are dealt out as pairs of blocks. Connected components join the rest.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite components link with nothing;
vectors of unlike length do not link; rows that share an id are one node and count as that many vectors; a null id
never links; an empty table gives an empty table. Only the two named columns are read, so others may have any name.
Vectors of any length are taken; a task holds two blocks of them. Equal vectors have the smallest id as their class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.storage import settle, ship
from ledgerline.operators.components import components

#: A table of large buckets of up to so many rows (16 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_BUCKETS = 200_000


@dataclass(frozen=True)
class Codes:
    """Parameters of the codes; ``slice_bits`` and ``tables`` are worked out by ``sized``."""

    threshold: float = 0.95
    missed: float = 0.0002
    sigmas: float = 5.0
    seed: int = 20_240_501
    block: int = 1024
    slice_bits: int = 8
    tables: int = 16

    def sized(self, vectors: int) -> Codes:
        bits = min(36, max(6, math.ceil(math.log2(max(vectors, 2))) - 9))
        agree = (1 - math.acos(self.threshold) / math.pi) ** bits
        tables = math.ceil(math.log(self.missed) / math.log(1 - agree))
        return Codes(**{**self.__dict__, "slice_bits": bits, "tables": tables})


@lru_cache(maxsize=8)
def rotations(dimension: int, count: int, seed: int) -> np.ndarray:
    """``count`` random orthogonal matrices, the same in every process."""
    random = np.random.default_rng([seed, dimension])
    return np.stack([np.linalg.qr(random.standard_normal((dimension, dimension)))[0] for _ in range(count)])


def unit(vector) -> np.ndarray | None:
    """The vector with length one in double precision, or None if it has no direction."""
    if vector is None or not len(vector) or any(x is None for x in vector):
        return None
    x = np.array(vector, np.float64)
    most = np.abs(x).max()
    if not np.isfinite(most) or most == 0:
        return None
    x = x / most
    return x / math.sqrt(float(x @ x))


def _units(column: pa.Array) -> list[np.ndarray | None]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [unit(v) for v in column.to_pylist()]


@dataclass(frozen=True)
class Stored:
    """Codes of vectors (rows): odd integers up to 15 whose signs are the binary code, and three numbers of each."""

    slices: np.ndarray  # bits of the hash tables, packed
    levels: np.ndarray
    factor: np.ndarray  # inner product of the turned vector with its signs (both of length one)
    step: np.ndarray    # half the distance of two levels
    rest: np.ndarray    # length of what the levels leave out

    def packed(self) -> list[bytes]:
        nibbles = ((self.levels + 15) >> 1).astype(np.uint8)
        if nibbles.shape[1] % 2:
            nibbles = np.pad(nibbles, ((0, 0), (0, 1)))
        numbers = np.stack([self.factor, self.step, self.rest], axis=1).astype("<f4").view(np.uint8)
        return [row.tobytes() for row in np.hstack([self.slices, nibbles[:, ::2] << 4 | nibbles[:, 1::2], numbers])]

    @classmethod
    def unpacked(cls, rows: list[bytes], dimension: int, codes: Codes) -> Stored:
        raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
        at = -(-codes.tables * codes.slice_bits // 8)
        nibbles = raw[:, at:-12]
        levels = np.stack([nibbles >> 4, nibbles & 15], axis=2).reshape(len(rows), -1)[:, :dimension]
        numbers = np.ascontiguousarray(raw[:, -12:]).view("<f4")
        return cls(raw[:, :at], levels.astype(np.int16) * 2 - 15, *numbers.T)


def encode(units: np.ndarray, codes: Codes) -> Stored:
    dimension = units.shape[1]
    needed = codes.tables * codes.slice_bits
    sliced = np.hstack([units @ turn.T for turn in rotations(dimension, -(-needed // dimension), codes.seed)])
    turned = units @ rotations(dimension, 1, codes.seed + 1)[0].T
    step = np.abs(turned).max(axis=1) / 16
    levels = np.clip(np.floor(turned / (2 * step[:, None])), -8, 7).astype(np.int16) * 2 + 1
    return Stored(np.packbits(sliced[:, :needed] > 0, axis=1), levels, np.abs(turned).sum(axis=1) / math.sqrt(dimension),
                  step, np.linalg.norm(turned - levels * step[:, None], axis=1))


def slice_keys(slices: np.ndarray, codes: Codes) -> np.ndarray:
    """The key of each vector (row) in each table (column)."""
    bits = np.unpackbits(slices, axis=1, count=codes.tables * codes.slice_bits)
    return bits.reshape(len(slices), codes.tables, codes.slice_bits) @ (1 << np.arange(codes.slice_bits, dtype=np.int64))


def guesses(stored: Stored, codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimated inner products of each vector's signs (row) with each vector's levels (column), the deviations that
    the rotation may bring to a row, and what the levels leave out of each."""
    dimension = stored.levels.shape[1]
    levels = stored.levels.astype(np.float32)
    exact = np.sign(levels) @ levels.T  # sums of small integers
    over = 1 / (stored.factor.astype(np.float32) * np.float32(math.sqrt(dimension)))
    spread = np.sqrt((1 - stored.factor**2).clip(0) / stored.factor**2 / max(dimension - 1, 1))
    left = np.outer(1 / stored.factor, stored.rest).astype(np.float32)
    return exact * over[:, None] * stored.step.astype(np.float32), codes.sigmas * spread, left


def estimates(units: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of each vector's code (row) with each vector (column), and each row's error bound,
    which holds for pairs at any angle."""
    guess, spread, left = guesses(encode(units, codes), codes)
    return guess, spread + left.max(axis=1)


#: Pairs of a unit that are looked at together.
PAIRS = 1 << 16


def surviving(stored: Stored, table: int, blocks: np.ndarray | None, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one unit that meet here first and whose bounds reach the threshold.

    ``blocks``, in a unit of two blocks, tells which of them a vector is from: only pairs across them count.
    """
    guess, spread, left = guesses(stored, codes)
    # The error of a pair shrinks with the sine of its angle; it need only hold for pairs on the threshold or closer.
    sine = np.float32(math.sqrt(max(0.0, 1 - codes.threshold**2)))
    above = guess + (spread.astype(np.float32) * sine)[:, None] + left >= np.float32(codes.threshold - 1e-5)
    a, b = np.nonzero(np.triu(above & above.T, 1))
    keys = slice_keys(stored.slices, codes)
    keep = np.concatenate([np.zeros(0, bool)] + [
        (keys[a[i:i + PAIRS], :table] != keys[b[i:i + PAIRS], :table]).all(axis=1) for i in range(0, len(a), PAIRS)])
    if blocks is not None:
        keep &= blocks[a] != blocks[b]
    return a[keep], b[keep]


def compare(units: np.ndarray, a: np.ndarray, b: np.ndarray, weights: np.ndarray,
            codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each vector of one unit from the pairs (a, b) that are to be computed exactly: copies linked
    with it here, and the smallest row connected with it."""
    some = max(1, PAIRS * 64 // units.shape[1])
    exact = np.concatenate([np.zeros(0)] + [
        np.einsum("ij,ij->i", units[a[i:i + some]], units[b[i:i + some]]) for i in range(0, len(a), some)])
    a, b = a[exact >= codes.threshold], b[exact >= codes.threshold]
    links = np.zeros(len(units), np.int64)
    np.add.at(links, a, weights[b])
    np.add.at(links, b, weights[a])
    root = np.arange(len(units))
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return links, root


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, d1, d2) of all rows, d1 being null for vectors without direction; and (id, weight, unit) of the distinct
    ones, with the smallest id of equal vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(batch.column(1))
            codes = [None if u is None else divmod(xxhash.xxh3_128_intdigest((u + 0.0).tobytes()), 1 << 64) for u in units]
            halves = [pa.array([None if c is None else c[k] - (c[k] >> 63 << 64) for c in codes], pa.int64())
                      for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *halves, pa.array([None if u is None else u.tobytes() for u in units], pa.binary())],
                names=["id", "d1", "d2", "unit"])

    rows = settle(vectors.mapInArrow(run, "id bigint, d1 bigint, d2 bigint, unit binary"), "vectors")
    stands = (rows.where("d1 IS NOT NULL AND id IS NOT NULL").groupBy("d1", "d2")
              .agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("unit").alias("unit")))
    return rows.drop("unit"), settle(stands, "distinct-vectors")


def _by_size(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for size in np.unique(sizes):
        yield int(size), np.flatnonzero(sizes == size)


def coded(stands: DataFrame, codes: Codes) -> DataFrame:
    """(id, weight, size, code) of the distinct vectors: their stored codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            for size, rows in _by_size(np.array([len(u) // 8 for u in raw])):
                units = np.frombuffer(b"".join(raw[r] for r in rows), np.float64).reshape(len(rows), -1)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(pa.array(rows)) for k in range(2)),
                     pa.array(np.full(len(rows), size, np.int32)), pa.array(encode(units, codes).packed(), pa.binary())],
                    names=["id", "weight", "size", "code"])

    return stands.select("id", "weight", "unit").mapInArrow(run, "id bigint, weight bigint, size int, code binary")


def bucketed(stored: DataFrame, codes: Codes) -> DataFrame:
    """One row for each vector and table: (bucket, tbl, id, weight, size, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = -(-codes.tables * codes.slice_bits // 8)
        for batch in batches:
            if not batch.num_rows:
                continue
            slices = np.frombuffer(b"".join(c[:width] for c in batch.column(3).to_pylist()), np.uint8)
            keys = slice_keys(slices.reshape(batch.num_rows, width), codes)
            table = np.tile(np.arange(codes.tables, dtype=np.int32), len(keys))
            take = np.repeat(np.arange(len(keys)), codes.tables)
            size = batch.column(2).to_numpy().astype(np.int64)
            bucket = (keys.ravel() * codes.tables + table) * 65_536 + size[take] % 65_536
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.array(table), *(batch.column(k).take(pa.array(take)) for k in range(4))],
                names=["bucket", "tbl", "id", "weight", "size", "code"])

    return stored.select("id", "weight", "size", "code").mapInArrow(
        run, "bucket bigint, tbl int, id bigint, weight bigint, size int, code binary")


UNIT = ["bucket", "low", "high"]
CODED = [*UNIT, "block", "tbl", "id", "weight", "size", "code"]
CODED_SCHEMA = ("bucket bigint, low bigint, high bigint, block bigint, tbl int, id bigint, weight bigint, size int, "
                "code binary")


def _units_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each unit, which come one after the other."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        unit = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
        cuts = [0, *(np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1).tolist(), len(unit)]
        for start, stop in zip(cuts, cuts[1:]):
            if start == stop:
                continue
            if now != tuple(unit[start]):
                if held:
                    yield pa.Table.from_batches(held)
                held, now = [], tuple(unit[start])
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def _of_one_size(whole: pa.Table) -> Iterator[pa.Table]:
    """A unit's rows by the length of their vectors: one table, but for lengths that share a bucket."""
    sizes = whole.column("size").to_numpy()
    if (sizes == sizes[0]).all():
        yield whole
    else:
        for _, rows in _by_size(sizes):
            yield whole.take(pa.array(rows))


def _pairs(rows: pa.Table, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    stored = Stored.unpacked(rows.column("code").to_pylist(), rows.column("size")[0].as_py(), codes)
    blocks = rows.column("block").to_numpy() if rows.column("low")[0] != rows.column("high")[0] else None
    return surviving(stored, rows.column("tbl")[0].as_py(), blocks, codes)


def _survivors(rows: DataFrame, codes: Codes) -> DataFrame:
    """The rows of each unit that are in a pair which the estimates cannot rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _units_in(batches):
            for part in _of_one_size(whole):
                some = np.unique(np.concatenate(_pairs(part, codes)))
                if len(some):
                    yield from part.take(pa.array(some)).combine_chunks().to_batches()

    return (rows.select(*CODED).repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(run, CODED_SCHEMA))


def _compared(rows: DataFrame, codes: Codes) -> DataFrame:
    """(id, links, root) of rows of units with their vectors: pairs that the estimates leave, computed exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _units_in(batches):
            for part in _of_one_size(whole):
                units = np.frombuffer(b"".join(part.column("unit").to_pylist()), np.float64)
                ids, weights = (part.column(c).to_numpy() for c in ("id", "weight"))
                links, root = compare(units.reshape(len(ids), -1), *_pairs(part, codes), weights, codes)
                some = (links > 0) | (root != np.arange(len(root)))
                if some.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[some]), pa.array(links[some]), pa.array(ids[root][some])],
                        names=["id", "links", "root"])

    return (rows.select(*CODED, "unit").repartition(*UNIT).sortWithinPartitions(*UNIT)
            .mapInArrow(run, "id bigint, links bigint, root bigint"))


def units_of(buckets: DataFrame, codes: Codes) -> DataFrame:
    """Rows of each unit of comparison: a bucket (low = high = 0), or a block, or two blocks, of a large bucket."""
    large = settle(buckets.select("bucket").groupBy("bucket").agg(F.count("*").alias("n")).where(
        F.col("n") > 2 * codes.block).select("bucket", F.ceil(F.col("n") / codes.block).cast("long").alias("blocks")),
        "large-buckets")
    few = large.count() <= BROADCAST_BUCKETS
    marked = buckets.join(F.broadcast(large) if few else large, "bucket", "left")
    block = F.coalesce(F.expr("pmod(xxhash64(id, bucket), blocks)"), F.lit(0))
    partner = F.explode(F.expr("CASE WHEN blocks IS NULL THEN array(0L) ELSE sequence(0L, blocks - 1) END"))
    return (marked.withColumn("block", block).withColumn("partner", partner)
            .withColumns({"low": F.least("block", "partner"), "high": F.greatest("block", "partner")}))


def deduplicate(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
                codes: Codes = Codes()) -> DataFrame:
    """Per row: key, n_links, component_id (smallest key reachable by links, itself included), kept."""
    ship(vectors.sparkSession)
    rows, stands = distinct_vectors(vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")))
    codes = codes.sized(stands.count())
    stored = settle(coded(stands, codes), "codes")
    left = settle(_survivors(units_of(bucketed(stored, codes), codes), codes), "survivors")
    found = settle(_compared(left.join(stands.select("id", "unit"), "id"), codes), "links")
    groups = components(found.select(F.col("root").alias("a"), F.col("id").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    nodes = (stands.join(links, "id", "left")
             .join(groups.select(F.col("node").alias("id"), "component"), "id", "left")
             .groupBy("d1", "d2").agg((F.max(F.coalesce("links", F.lit(0))) + F.max("weight") - 1).alias("links"),
                                      F.min(F.coalesce("component", "id")).alias("component")))
    out = rows.join(nodes, ["d1", "d2"], "left").select(
        F.col("id").alias(key), F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).cast("long")
        .alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
