"""N-gram Jaccard join (5): all documents whose sets of five-word shingles overlap by at least 0.8, by prefix trees.

1. One pass over the texts writes each set's size, its 128-bit digest and a parity sketch (a bit map in which every
   shingle flips one bit, with a bit for each shingle at least), and counts shingles that are common among some
   thousand documents (lossy counting). The counts only fix the global order of shingles, from rare to common.
2. Equal sets are represented by the smallest id that has one. A second pass sends out the first few shingles of each
   ordered set: sets that overlap enough share one of them. Documents that meet in a shingle are compared by their
   sketches: two sets differ in at least as many shingles as their sketches differ in bits, so what is ruled out cannot
   link. What is not becomes an edge, as far as it connects something new. Shingles with the same documents are looked
   at once, and one with more than ``Bounds.together`` documents is dealt out in blocks.
3. Sets joined by such edges form candidate groups; no two linked sets lie in different groups. A sketch with fewer bits
   than shingles is nearly as full for any two sets, so it would let unrelated ones through, and their number grows with
   the square of the documents of a shingle until they tie most groups into one. Each group's sets are stored in a trie.
   Probes walk it, sharing partial overlaps along common paths and pruning subtrees whose remaining lengths cannot reach
   the needed overlap, whose sketches rule them out, or that already belong to the probe's component. A group beyond ``Bounds`` is compared with one
   pivot first; what does not link with the pivot is compared with the group in pairs of blocks, so that no task holds
   more than two blocks. Every pair of sets that could link is either compared or already connected; only links that
   connect something new are put out.
4. Connected components over those links and over the copies.

Shingles are 64-bit hashes of lower-cased words, compared within pairs of sets only.

Defined results: null or empty text has no shingles and links with nothing; rows that share an id are one node, each
with its own size; rows with a null id are never linked (null component); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.storage import settle, ship
from ledgerline.operators.components import components

#: How many of the commonest shingles have a place of their own in the global order (16 bytes each on every executor).
COMMON = 100_000
#: Text whose shingles a task holds at a time.
SLICE_BYTES = 4_000_000
#: Shingles that a task holds to count the common ones among them.
COUNTED = 4_000_000
#: A group table up to this size (some 40 bytes a row) is broadcast to the texts; a larger one is joined by shuffle.
BROADCAST_ROWS = 300_000
#: Up to so many ids of copies (8 bytes each) are broadcast to the second pass; more are joined by shuffle.
BROADCAST_COPIES = 4_000_000


@dataclass(frozen=True)
class Likeness:
    """Two sets link if ``out_of * intersection >= least * union``."""

    words: int = 5
    least: int = 80
    out_of: int = 100

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Shingles of a set of ``n`` of which any linked set holds one."""
        return n - (self.least * n + self.out_of - 1) // self.out_of + 1

    def needed(self, sizes: int) -> int:
        """Smallest overlap of linked sets whose sizes add up to ``sizes``."""
        whole = self.least + self.out_of
        return (self.least * sizes + whole - 1) // whole

    def differing(self, sizes: np.ndarray) -> np.ndarray:
        """Most shingles that only one of two linked sets holds, if their sizes add up to ``sizes``."""
        whole = self.least + self.out_of
        return sizes - 2 * ((self.least * sizes + whole - 1) // whole)

    def linked(self, overlap: int, sizes: int) -> bool:
        return self.out_of * overlap >= self.least * (sizes - overlap)


@dataclass(frozen=True)
class Bounds:
    """What a task compares at a time: whole sets and their shingles, and documents of a shingle by their sketches."""

    sets: int = 2000
    shingles: int = 2_000_000
    together: int = 4096


def shingles(text: str | None, words: int) -> np.ndarray:
    """Distinct shingles as sorted 64-bit hashes; a text with fewer words is one shingle."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    width = min(n, words)
    value = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        value = value * np.uint64(0x9E3779B97F4A7C15) + hashes[k:n - width + 1 + k]
        value ^= value >> np.uint64(29)
    return np.unique(value)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) in batches of about ``SLICE_BYTES`` of text, which bounds what a task holds."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of some sets, and the number of the set that each belongs to."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.repeat(np.arange(len(sets)), sizes)


#: Bits of the smallest sketch; a set has at most one shingle per bit.
LEAST_BITS = 512


def sketches(flat: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The parity sketch of each set: bit ``shingle mod bits``, flipped by every shingle; ``bits`` follows the size."""
    bits = LEAST_BITS << np.ceil(np.log2(np.maximum(sizes / LEAST_BITS, 1))).astype(np.int64)
    found: list[bytes] = [b""] * len(sizes)
    ends = np.cumsum(sizes)
    for wide in np.unique(bits[sizes > 0]).tolist():
        rows = np.flatnonzero((bits == wide) & (sizes > 0))
        step = max(1, 4_000_000 // wide)
        for part in (rows[k:k + step] for k in range(0, len(rows), step)):
            place = np.full(len(sizes), -1)
            place[part] = np.arange(len(part))
            low, high = ends[part[0]] - sizes[part[0]], ends[part[-1]]
            local = place[owner[low:high]]
            used = local >= 0
            at = local[used] * wide + (flat[low:high][used] & np.uint64(wide - 1)).astype(np.int64)
            odd = (np.bincount(at, minlength=len(part) * wide) & 1).astype(np.uint8).reshape(len(part), wide)
            packed = np.packbits(odd, axis=1, bitorder="little")
            for row, line in zip(part.tolist(), packed):
                found[row] = line.tobytes()
    return found


def measure(documents: DataFrame, like: Likeness) -> DataFrame:
    """Written rows (counted, id, n, d1, d2, sketch): a set's size, digest and sketch; or (``counted``) a common
    shingle and its count."""

    def rows(counted: bool, ids: pa.Array, n: np.ndarray, d1: np.ndarray, d2: np.ndarray, maps: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), counted)), ids, pa.array(n), pa.array(d1), pa.array(d2), pa.array(maps, pa.binary())],
            names=["counted", "id", "n", "d1", "d2", "sketch"])

    def common(held: list[np.ndarray], texts: int) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= max(3, texts // 2000)
        values, counts = values[often].astype(np.int64), counts[often]
        return rows(True, pa.nulls(len(values), pa.int64()), counts, values, np.zeros(len(values), np.int64),
                    [None] * len(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts = [], 0
        for batch in _slices(batches):
            sets = [shingles(text, like.words) for text in batch.column(1).to_pylist()]
            digests = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets],
                               np.uint64).reshape(-1, 2).astype(np.int64)
            flat, owner = _flat(sets)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            yield rows(False, batch.column(0), sizes, digests[:, 0], digests[:, 1], sketches(flat, owner, sizes))
            held.append(flat)
            texts += len(sets)
            if sum(map(len, held)) > COUNTED:
                yield common(held, texts)
                held, texts = [], 0
        if held:
            yield common(held, texts)

    return settle(documents.mapInArrow(
        run, "counted boolean, id bigint, n bigint, d1 bigint, d2 bigint, sketch binary"), "sets")


class Order:
    """The global order of shingles: by class of frequency, then by hash."""

    def __init__(self, values: np.ndarray, classes: np.ndarray):
        at = np.argsort(values)
        self.values = np.append(values[at], np.uint64(2**64 - 1))
        self.classes = np.append(classes[at], np.int8(0))

    def of(self, flat: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.values, flat)
        return np.where(self.values[at] == flat, self.classes[at], np.int8(0))


def common_order(measured: DataFrame) -> Order:
    """The commonest shingles by counted documents. Their number is bounded; all others come first, in hash order."""
    top = (measured.where("counted").groupBy("d1").agg(F.sum("n").alias("n")).where("n >= 16")
           .orderBy(F.desc("n"), "d1").limit(COMMON).toPandas())
    counts = top["n"].to_numpy(np.int64)
    return Order(top["d1"].to_numpy(np.int64).astype(np.uint64), np.log2(np.maximum(counts, 1)).astype(np.int8))


def copies_of(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The smallest id of each set that is not empty (d1, d2, n, id), written; and (a, b): ids b with the same set."""
    sets = sets.where("n > 0 AND id IS NOT NULL").select("id", "n", "d1", "d2")
    stands = settle(sets.groupBy("d1", "d2", "n").agg(F.min("id").alias("id")), "representatives")
    copies = sets.join(stands.withColumnRenamed("id", "a"), ["d1", "d2", "n"]).where("id != a")
    return stands, settle(copies.select("a", F.col("id").alias("b")), "copies")


def spared(documents: DataFrame, stands: DataFrame, copies: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Ids whose sets are all represented by other ids, sorted; if they are very many, ``documents`` come without them."""
    ids = settle(copies.select(F.col("b").alias("id")).distinct().join(stands.select("id"), "id", "left_anti"), "spared")
    if ids.count() > BROADCAST_COPIES:
        return documents.join(ids.hint("shuffle_hash"), "id", "left_anti"), np.empty(0, np.int64)
    return documents, np.sort(ids.toPandas()["id"].to_numpy(np.int64))


def postings(documents: DataFrame, skip: np.ndarray, order: Order, like: Likeness, together: int) -> DataFrame:
    """Written rows (hot, ids): documents that share a prefix shingle, where ``hot`` is a shingle whose documents come
    in several rows; without the ids in ``skip``, which is sorted."""
    shared = documents.sparkSession.sparkContext.broadcast((order.values, order.classes, skip))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Order.__new__(Order)
        known.values, known.classes, skip = shared.value
        for batch in _slices(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if len(skip):
                batch = batch.filter(pa.array(skip[np.minimum(np.searchsorted(skip, ids), len(skip) - 1)] != ids))
                ids = batch.column(0).to_numpy(zero_copy_only=False)
            sets = [shingles(text, like.words) for text in batch.column(1).to_pylist()]
            flat, owner = _flat(sets)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            by = np.lexsort((known.of(flat), owner))  # stable, and each set is in hash order already
            flat, first = flat[by], np.cumsum(sizes) - sizes
            take = np.arange(len(flat)) - first[owner] < like.prefix(sizes)[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[take].astype(np.int64)), pa.array(ids[owner[take]], pa.int64())], names=["shingle", "id"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents of each shingle that has two or more; a shingle with very many goes out in parts."""
        key, hub, rest = None, None, np.empty(0, np.int64)  # the shingle that may go on, its first document if parted

        def out(values: np.ndarray, sizes: np.ndarray, hot: int | None = None) -> pa.RecordBatch:
            ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array([hot] * len(sizes), pa.int64()),
                                               pa.ListArray.from_arrays(ends, pa.array(values, pa.int64()))],
                                              names=["hot", "ids"])

        def parts(docs: np.ndarray) -> pa.RecordBatch:
            ids = [np.unique(np.append(docs[k:k + together], hub)) for k in range(0, len(docs), together)]
            return out(np.concatenate(ids) if ids else docs, np.fromiter(map(len, ids), np.int64, len(ids)), key)

        def held() -> Iterator[pa.RecordBatch]:
            if hub is not None:
                yield parts(rest)
            elif len(rest) > 1:
                yield out(rest, np.array([len(rest)]))

        for batch in batches:
            shingle, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            if not len(shingle):
                continue
            fresh = np.append(True, (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1]))  # rows may share an id
            shingle, doc = shingle[fresh], doc[fresh]
            cuts = np.concatenate([[0], np.flatnonzero(shingle[1:] != shingle[:-1]) + 1, [len(shingle)]])
            sizes = np.diff(cuts)
            # What begins and ends in this batch goes out at once, but for what is too long.
            whole = (sizes > 1) & (sizes <= together)
            whole[[0, -1]] = False
            if whole.any():
                yield out(doc[np.repeat(whole, sizes)], sizes[whole])
            loose = sizes > together
            loose[[0, -1]] = True
            for k in np.flatnonzero(loose).tolist():
                some = doc[cuts[k]:cuts[k + 1]]
                if shingle[cuts[k]] != key:
                    yield from held()
                    key, hub, rest = shingle[cuts[k]], None, some
                else:
                    rest = np.append(rest, some[1:] if len(rest) and rest[-1] == some[0] else some)
                if len(rest) > together:
                    hub = rest[0] if hub is None else hub
                    full = len(rest) // together * together
                    yield parts(rest[:full])
                    rest = rest[full:]
        yield from held()

    sent = documents.where("id IS NOT NULL").mapInArrow(prefixes, "shingle bigint, id bigint")
    placed = sent.repartition("shingle").sortWithinPartitions("shingle", "id")
    return settle(placed.mapInArrow(runs, "hot bigint, ids array<bigint>"), "postings")


def plausible(ids: np.ndarray, sizes: np.ndarray, maps: list[bytes], asks: np.ndarray,
              like: Likeness) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges that connect all sets which their sketches do not rule out, and the connected sets' labels.

    Only pairs with a set that ``asks`` are looked at. Sets whose sketches are twice as wide as others' are folded for
    the comparison; sets further apart in size cannot link.
    """
    labels, edges = np.arange(len(ids)), []
    widths = np.fromiter(map(len, maps), np.int64, len(maps))

    def compare(k: int, look: np.ndarray) -> None:
        """Connect row ``k`` with what it may link with among the rows ``look``."""
        i = rows[k]
        look = look[labels[rows[look]] != labels[i]]
        less, more = np.minimum(n[look], n[k]), np.maximum(n[look], n[k])
        look = look[like.least * more <= like.out_of * less]
        if not len(look):
            return
        apart = np.bitwise_count(lines[look] ^ lines[k]).sum(axis=1)
        near = rows[look[apart <= like.differing(n[look] + n[k])]]
        joined, at = np.unique(labels[near], return_index=True)
        if len(joined):
            edges.extend((int(ids[i]), int(ids[j])) for j in near[at])
            labels[np.isin(labels, joined)] = labels[i]

    for wide in np.unique(widths[widths > 0]).tolist():
        narrow, double = np.flatnonzero(widths == wide), np.flatnonzero(widths == 2 * wide)
        lines = np.frombuffer(b"".join(maps[i] for i in narrow), np.uint64).reshape(len(narrow), -1)
        if len(double):
            folded = np.frombuffer(b"".join(maps[i] for i in double), np.uint64).reshape(len(double), 2, -1)
            lines = np.concatenate([lines, folded[:, 0] ^ folded[:, 1]])
        rows = np.concatenate([narrow, double])
        n, left, wider = sizes[rows], asks[rows], np.arange(len(rows)) >= len(narrow)
        if left.all() and len(rows) > 2:
            # Copies of the first one are connected with it; what they could link with looks at them from its side.
            compare(0, np.arange(1, len(rows)))
            left = labels[rows] != labels[rows[0]]
        # Each of those left looks at all rows, but at the ones before it among those left. Two wide ones are compared
        # in the next round.
        by = np.argsort(np.where(left, 0, 2) + wider, kind="stable")
        asking, plain = int(left.sum()), int((left & ~wider).sum())
        ordinary = asking + int((~left & ~wider).sum())
        for at, k in enumerate(by[:asking].tolist()):
            compare(k, by[at + 1:] if at < plain else by[asking:ordinary])
    return edges, labels


def _sketched(units: DataFrame, like: Likeness) -> DataFrame:
    """(a, b, open_id) of rows (unit, id, n, sketch, asks, hub): edges, and documents not connected with the hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _units(batches, 5):
            ids, sizes, maps, asks = (np.array(rows[0]), np.array(rows[1]), rows[2], np.array(rows[3], bool))
            edges, labels = plausible(ids, sizes, maps, asks, like)
            hub = rows[4][0]
            far = [] if hub is None else ids[labels != labels[int(np.flatnonzero(ids == hub)[0])]].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[0] for e in edges] + [None] * len(far), pa.int64()),
                 pa.array([e[1] for e in edges] + [None] * len(far), pa.int64()),
                 pa.array([None] * len(edges) + far, pa.int64())], names=["a", "b", "open_id"])

    return (units.select("unit", "id", "n", "sketch", "asks", "hub").repartition("unit")
            .sortWithinPartitions("unit", "id").mapInArrow(run, "a bigint, b bigint, open_id bigint"))


def candidate_edges(found: DataFrame, sets: DataFrame, like: Likeness, together: int) -> DataFrame:
    """Edges (a, b) that connect all documents which meet in a shingle and may link; ``found`` are the postings."""
    maps = sets.where("n > 0").select("id", "n", "sketch")

    def unit(rows: DataFrame, asks) -> DataFrame:
        return rows.withColumn("asks", asks).join(maps, "id")

    small = found.where("hot IS NULL").select("ids").distinct().select(
        F.xxhash64("ids").alias("unit"), F.explode("ids").alias("id"), F.lit(None).cast("long").alias("hub"))
    edges = _sketched(unit(small, F.lit(True)), like).select("a", "b")
    hot = found.where("hot IS NOT NULL")
    if not hot.isEmpty():
        # The first document of a parted shingle is in all its parts.
        hubs = hot.groupBy("hot").agg(F.min(F.array_min("ids")).alias("hub"))
        parts = hot.join(hubs, "hot").select("hot", F.xxhash64("hot", "ids").alias("unit"), "hub", "ids")
        members = parts.select("unit", "hub", F.explode("ids").alias("id"))
        near = settle(_sketched(unit(members, F.lit(True)), like), "parted")
        far = settle(near.where("open_id IS NOT NULL").select("open_id").distinct()
                     .join(parts.select("hot", F.explode("ids").alias("open_id")).distinct(), "open_id"), "far")
        edges = edges.unionByName(near.where("a IS NOT NULL").select("a", "b"))
        # What is far from its hub is compared with every part, in bounded shares.
        counted = far.groupBy("hot").agg(F.count("*").alias("n_far"))
        shares = far.join(counted, "hot").select(
            "hot", F.col("open_id").alias("id"), "n_far",
            F.expr(f"pmod(xxhash64(open_id), greatest(1L, n_far div {together}))").alias("share"))
        against = (parts.join(counted, "hot").withColumn(
            "share", F.explode(F.expr(f"sequence(0L, greatest(1L, n_far div {together}) - 1)")))
            .select("hot", "share", "unit", "ids"))
        asking = against.select("hot", "share", "unit").join(shares.drop("n_far"), ["hot", "share"]).select(
            F.xxhash64("unit", "share").alias("unit"), "id", F.lit(True).alias("asked"))
        asked = against.select(F.xxhash64("unit", "share").alias("unit"), F.explode("ids").alias("id"),
                               F.lit(False).alias("asked"))
        both = asking.unionByName(asked).groupBy("unit", "id").agg(F.max("asked").alias("asks"))
        crossed = _sketched(both.withColumn("hub", F.lit(None).cast("long")).join(maps, "id"), like)
        edges = edges.unionByName(crossed.select("a", "b"))
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


class Trie:
    """Sets as paths of a compressed trie; the commonest shingle of the group comes first on every path."""

    def __init__(self, sets: list[np.ndarray], like: Likeness):
        self.like = like
        values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int64)
        rank[np.lexsort((values, -counts))] = np.arange(len(values))
        ends = np.cumsum([len(s) for s in sets])
        paths = [np.sort(p) for p in np.split(rank[codes], ends[:-1])]
        self.width = len(values)
        self.member = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())
        self.paths = [paths[i] for i in self.member]
        self.sizes = np.array([len(p) for p in self.paths])
        self._sketch()
        self._build()

    def _sketch(self) -> None:
        """A parity sketch of each path, of one width; the commonest shingles have a bit of their own."""
        wide = 1 << min(15, max(9, int(8 * self.sizes.mean()).bit_length()))
        step = max(1, 4_000_000 // wide)
        lines = []
        for k in range(0, len(self.paths), step):
            flat, owner = _flat(self.paths[k:k + step])
            odd = np.bincount(owner * wide + (flat & (wide - 1)), minlength=len(self.paths[k:k + step]) * wide) & 1
            lines.append(np.packbits(odd.astype(np.uint8).reshape(-1, wide), axis=1, bitorder="little").view(np.uint64))
        self.lines = np.concatenate(lines)

    def _build(self) -> None:
        """Nodes in preorder: (shingles on the edge, first and last path below, depth, shortest and longest below)."""
        common = [0]
        for before, path in zip(self.paths, self.paths[1:]):
            n = min(len(before), len(path))
            differ = np.flatnonzero(before[:n] != path[:n])
            common.append(int(differ[0]) if len(differ) else n)
        self.nodes: list[list] = []
        self.children: list[list[int]] = []

        def grow(lo: int, hi: int, depth: int) -> int:
            """The node of paths ``lo`` to ``hi`` (exclusive), which share their first ``depth`` shingles."""
            end = min(common[lo + 1:hi]) if hi - lo > 1 else len(self.paths[lo])
            number = len(self.nodes)
            sizes = self.sizes[lo:hi]
            self.nodes.append([self.paths[lo][depth:end], lo, hi, end, int(sizes.min()), int(sizes.max())])
            self.children.append([])
            if hi - lo > 1:
                cuts = [lo, *(i for i in range(lo + 1, hi) if common[i] == end), hi]
                todo.append((number, end, cuts))
            return number

        todo: list[tuple[int, int, list[int]]] = []
        grow(0, len(self.paths), 0)
        while todo:
            parent, depth, cuts = todo.pop()
            self.children[parent] = [grow(a, b, depth) for a, b in zip(cuts, cuts[1:])]

    def links(self, probe: int, labels: np.ndarray) -> Iterator[int]:
        """Paths linked with path ``probe`` whose label differs from its label when they are reached."""
        path, size, like = self.paths[probe], int(self.sizes[probe]), self.like
        look = np.flatnonzero(labels != labels[probe])
        apart = np.bitwise_count(self.lines[look] ^ self.lines[probe]).sum(axis=1)
        look = look[apart <= like.differing(size + self.sizes[look])]  # the sketches rule the others out
        if not len(look):
            return
        held = np.zeros(self.width + 1, np.int64)
        held[path + 1] = 1
        upto = np.cumsum(held)  # shingles of the probe before each place of the order
        todo = [(0, 0)]
        while todo:
            number, overlap = todo.pop()
            edge, lo, hi, depth, shortest, longest = self.nodes[number]
            below = look[np.searchsorted(look, lo):np.searchsorted(look, hi)]
            if not len(below) or (labels[below] == labels[probe]).all():
                continue
            if len(edge):
                overlap += int(held[edge + 1].sum())
                left = size - int(upto[edge[-1] + 1])
            else:
                left = size
            if hi - lo == 1:
                if like.linked(overlap, size + shortest):
                    yield lo
            elif overlap + min(left, longest - depth) >= like.needed(size + shortest):
                todo.extend((child, overlap) for child in self.children[number])


def connecting_links(ids: list[int], sets: list[np.ndarray], resolved: list[bool], like: Likeness) -> list[tuple]:
    """Links among some sets that connect what was not connected; sets marked resolved are connected already."""
    if len(ids) < 2:
        return []
    trie = Trie(sets, like)
    same = [resolved[i] for i in trie.member]
    labels = np.where(same, -1, np.arange(len(ids)))
    found = []
    for probe in range(len(ids)):
        if same[probe]:
            continue
        for other in trie.links(probe, labels):
            if labels[other] != labels[probe]:
                found.append((ids[trie.member[probe]], ids[trie.member[other]]))
                labels[labels == labels[other]] = labels[probe]
    return found


def _units(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[list]]:
    """The columns after the first, as lists, of each run of rows with equal first column."""
    now, held = None, [[] for _ in range(columns)]
    for batch in batches:
        unit = batch.column(0).to_numpy(zero_copy_only=False)
        values = [batch.column(k + 1).to_pylist() for k in range(columns)]
        cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
        for start, stop in zip(cuts, cuts[1:]):
            if start == stop:
                continue
            if unit[start] != now:
                if held[0]:
                    yield held
                now, held = unit[start], [[] for _ in range(columns)]
            for mine, all_ in zip(held, values):
                mine += all_[start:stop]
    if held[0]:
        yield held


def _compare(rows: DataFrame, like: Likeness) -> DataFrame:
    """Connecting links (a, b) of each unit of rows (unit, id, text, resolved)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, marks in _units(batches, 3):
            links = connecting_links(ids, [shingles(text, like.words) for text in texts], marks, like)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)],
                                             names=["a", "b"])

    return (rows.select("unit", "id", "text", "resolved").repartition("unit").sortWithinPartitions("unit", "id")
            .mapInArrow(run, "a bigint, b bigint"))


def _texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (id, ...) with the texts of each id."""
    few = wanted.count() <= BROADCAST_ROWS
    return documents.join(F.broadcast(wanted) if few else wanted, "id")


def _pivot_links(rows: DataFrame, like: Likeness) -> DataFrame:
    """(id, a, near) of each row (id, text, pivot_id, pivot_text): whether it links with its group's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for batch in batches:
            near = []
            for text, pivot, pivot_text in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if held[0] != pivot:
                    held = (pivot, shingles(pivot_text, like.words))
                own = shingles(text, like.words)
                overlap = len(np.intersect1d(own, held[1], assume_unique=True))
                near.append(like.linked(overlap, len(own) + len(held[1])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(near)],
                                             names=["id", "a", "near"])

    return rows.mapInArrow(run, "id bigint, a bigint, near boolean")


def blocks_of(bounds: Bounds) -> Column:
    """Blocks of half the bounds that the rows (n, ...) of a group make."""
    return F.ceil(F.greatest(F.count("*") * 2 / bounds.sets, F.sum("n") * 2 / bounds.shingles)).cast("long")


def _large_groups(texts: DataFrame, groups: DataFrame, like: Likeness, bounds: Bounds) -> DataFrame:
    """Connecting links of groups beyond the bounds; ``groups``: (grp, blocks, pivot_id)."""
    texts = settle(texts, "large-groups")
    pivots = groups.join(texts.select(F.col("id").alias("pivot_id"), F.col("text").alias("pivot_text")), "pivot_id")
    near = settle(_pivot_links(texts.select("id", "text", "grp").join(pivots, "grp")
                               .select("id", "text", "pivot_id", "pivot_text"), like), "pivot-links")
    marked = texts.join(near.groupBy("id").agg(F.min("near").alias("near")), "id").join(groups, "grp")
    # Blocks of the others and of the resolved by hash; every pair of blocks that holds an unresolved one is a unit.
    # Others are in blocks 0 to others - 1, so few of them make few units.
    others = marked.where("NOT near").groupBy("grp").agg(blocks_of(bounds).alias("others"))
    own = F.expr("CASE WHEN near THEN others + pmod(xxhash64(id), blocks) ELSE pmod(xxhash64(id), others) END")
    partners = F.expr("sequence(0L, CASE WHEN near THEN others - 1 ELSE others + blocks - 1 END)")
    pairs = (marked.join(others, "grp").withColumn("own", own).withColumn("partner", F.explode(partners))
             .withColumn("unit", F.xxhash64("grp", F.least("own", "partner"), F.greatest("own", "partner")))
             .withColumnRenamed("near", "resolved"))
    links = _compare(pairs.select("unit", "id", "text", "resolved"), like)
    return near.where("near AND id != a").select("a", F.col("id").alias("b")).unionByName(links)


def join(documents: DataFrame, key: str = "doc_id", text: str = "text", like: Likeness = Likeness(),
         bounds: Bounds = Bounds()) -> DataFrame:
    """Per row: ``key``, n_shingles, component_id (smallest key reachable by links, itself included)."""
    ship(documents.sparkSession)
    docs = documents.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    measured = measure(docs, like)
    sets = measured.where("NOT counted").drop("counted")
    stands, copies = copies_of(sets)
    found = postings(*spared(docs, stands, copies), common_order(measured), like, bounds.together)
    groups = components(candidate_edges(found, sets, like, bounds.together))
    grouped = stands.join(groups.select(F.col("node").alias("id"), F.col("component").alias("grp")), "id")
    by_group = settle(grouped.groupBy("grp").agg(
        F.count("*").alias("members"), blocks_of(bounds).alias("blocks"), F.min("id").alias("pivot_id")), "groups")
    wanted = grouped.groupBy("grp", "id").agg(F.sum("n").alias("n")).join(
        by_group.where("members > 1").select("grp", "blocks"), "grp")
    texts = _texts(docs, wanted.select("id", "n", "grp", "blocks"))
    small = texts.where("blocks <= 2").select(F.col("grp").alias("unit"), "id", "text", F.lit(False).alias("resolved"))
    links = _compare(small, like)
    large = by_group.where("blocks > 2 AND members > 1").select("grp", "blocks", "pivot_id")
    if not large.isEmpty():
        links = links.unionByName(_large_groups(texts.where("blocks > 2").drop("blocks"), large, like, bounds))
    found = components(links.unionByName(copies))
    return (sets.join(found, F.col("id") == F.col("node"), "left")
            .select(F.col("id").alias(key), F.col("n").alias("n_shingles"),
                    F.coalesce("component", "id").alias("component_id")))
