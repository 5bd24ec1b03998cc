"""Periodic run detection (11): online sparse diagonal dynamic programming over the words of each text.

Word ``i`` and an earlier occurrence of it, ``j``, lie on the diagonal of lag ``i - j``. A diagonal's match length grows
by one with each further pair of equal words and ends at the first unequal pair; a diagonal of lag ``q`` that ends with
enough matches is a run of period ``q``, which is put out at once: ``q`` words and then all that matched them.

The table is sparse because hardly any earlier occurrence can belong to a run. With at least three periods and 24 words
a run matches itself ``q`` words back over ``max(24 - q, 2 * q)`` words, never less than 16. So only occurrences of
whole stretches of ``span`` words count, ``span`` being 16, 32, 64, ...: a stretch of at least ``q`` words inside a run
has its nearest earlier occurrence exactly ``q`` words back (a nearer one would give the run a smaller period). Each
word thus has at most one active lag for each ``span``, and a word without one costs nothing in the loop. The work is
``n log n`` for any text, also for one word repeated a million times, where every earlier occurrence lies on a diagonal.

Stretches are looked up by a 64-bit hash and then compared word by word. Lengths of diagonals are advanced for all words
of a text by array operations; a task holds one text, its words as numbers, and its vocabulary.

Defined results: null or empty text has no runs and collapses to the empty text; texts of any length are taken whole;
repeated rows give repeated results; an empty table gives an empty table. Result columns replace input columns of the
same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.bpe import texts_of
from ledgerline.llm.columns import let, words_of
from ledgerline.llm.storage import ship

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: The shortest stretch that is looked up; no run matches itself over fewer words.
SHORTEST = min(max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q) for q in range(1, LEAST_WORDS))
#: Bytes of text that are cut into words, and words that are joined, at a time.
PIECE = 1 << 20

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def numbered(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The text's words as numbers, and the words by number. Words are parted by blank and U+0009 to U+000D."""
    known: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = text[at:end].split()
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), list(known)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _A ^ (b + _B) * _C
    h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    return h


def diagonals(words: np.ndarray, span: int, hashes: np.ndarray) -> Iterator[tuple[int, int, int]] | None:
    """(lag, first, last word that matches the word ``lag`` before it) of diagonals that hold ``span`` matches.

    ``hashes[i]`` stands for the ``span`` words from ``i`` on. None if no stretch of ``span`` words occurs twice.
    """
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    twice = np.flatnonzero(ranked[1:] == ranked[:-1])
    if not len(twice):
        return None
    at, lag = order[twice + 1], order[twice + 1] - order[twice]
    # Lags up to half of ``span`` were found with shorter stretches.
    fit = (lag <= span) if span == SHORTEST else (lag <= span) & (lag > span // 2)
    at, lag = at[fit], lag[fit]
    by_place = np.argsort(at)
    at, lag = at[by_place], lag[by_place]

    def ended() -> Iterator[tuple[int, int, int]]:
        # A diagonal goes on while the next word is active with the same lag.
        breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(lag) != 0)) + 1
        firsts, lasts = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(at)]]) - 1
        for first, last in zip(firsts.tolist(), lasts.tolist()):
            q, start, end = int(lag[first]), int(at[first]), int(at[last]) + span - 1
            matches = end - start + 1
            if matches >= max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q) and np.array_equal(
                    words[start:end + 1], words[start - q:end + 1 - q]):
                yield q, start, end

    return ended() if len(at) else iter(())


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and then period."""
    found = []
    hashes, span = words.astype(np.uint64), 1
    # Beyond the shortest stretches, a period of more than half of ``span`` must fit three times.
    while len(words) >= LEAST_WORDS and (span <= SHORTEST or LEAST_PERIODS * (span // 2 + 1) <= len(words)):
        if span >= SHORTEST:
            ended = diagonals(words, span, hashes)
            if ended is None:
                break
            found += [(start - q, end - start + 1 + q, q) for q, start, end in ended]
        hashes = _mixed(hashes[:-span], hashes[span:]) if span < len(hashes) else hashes[:0]
        span *= 2
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: np.ndarray, vocabulary: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """All words joined by one blank, but those that any run holds after its first period."""
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period:start + length] = False
        words = words[kept]
    step = PIECE // 8
    return b" ".join(b" ".join(map(vocabulary.__getitem__, words[i:i + step].tolist()))
                     for i in range(0, len(words), step))


def scan(documents: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Every row with ``runs``, an array of (start, length, period) in words, and ``collapsed``, the text without the
    repetitions: every run keeps its first period."""
    ship(documents.sparkSession)
    gone = {"runs", "collapsed"} | (set() if keep_text else {text.lower()})
    fields = [f for f in documents.schema if f.name.lower() not in gone]
    schema = T.StructType([*fields, T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, carried = 0, batch.num_columns - 1
            for texts in texts_of(batch.column(carried)):
                runs, short = [], []
                for value in texts:
                    words, vocabulary = numbered(value.encode())
                    found = runs_of(words)
                    runs.append([dict(zip(RUN.names, r)) for r in found])
                    short.append(collapsed(words, vocabulary, found).decode())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(row, len(texts)) for i in range(carried)),
                     pa.array(runs, kind), pa.array(short, pa.string())], names=schema.names)
                row += len(texts)

    content = F.col(f"`{text}`").cast("string").alias("_content")
    return documents.select(*[F.col(f"`{f.name}`") for f in fields], content).mapInArrow(run, schema)


def planted(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` in which one text in ten is made periodic from some word on, by a checksum of its id."""
    number = F.crc32(F.col(key).cast("string"))
    g = F.floor(number / 10)

    def periodic(words: Column) -> Column:
        n = F.size(words)
        return let(F.pmod(g, n), lambda a: let(F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))) + 1, lambda p: F.array_join(
            F.transform(words, lambda word, i: F.when(i < a, word).otherwise(
                F.get(words, (a + F.pmod(i - a, p)).cast("int")))), " ")))

    changed = let(words_of(F.col(text)), lambda words: F.when(F.size(words) > 0, periodic(words)).otherwise(F.col(text)))
    return documents.withColumn(text, F.when(F.pmod(number, F.lit(10)) == 0, changed).otherwise(F.col(text)))


def digests(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row the number of runs, the one with the greatest exponent, and digests of all runs and of the short text."""
    none = F.lit(None).cast(RUN)
    # Runs come by start and period, so the first of equal exponents is the one to keep.
    best = F.aggregate("runs", none, lambda top, r: F.when(
        top["start"].isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", *[r[c].cast("string") for c in RUN.names]), F.lit("\n"))), "")
    return scanned.withColumn("_best", best).select(
        key, F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_best.{c}").alias(c) for c in RUN.names],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
