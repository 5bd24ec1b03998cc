"""BPE encoding and decoding (6): byte-level BPE with a contiguous rank array per word.

A word is held as an array of its parts and, beside it, an array with the rank of each adjacent pair. The smallest rank
is found by scanning, its boundary deleted, and the two neighbouring ranks refreshed, until no pair has a rank. The
short words of a batch of texts go through together, as rows of one array. Scanning is quadratic in the word, so a word
of more than ``SHORT`` bytes uses a heap of ranks over linked parts, with the same result.

Texts are cut into words with array operations over their characters, by the rules of ``PATTERN``. Words repeat, so
each Python worker keeps a table of bounded size from a word's bytes (compared in full) to its ids.

The vocabulary is a ``tokenizers`` file (byte-level BPE without normaliser); its path must be readable on every
executor. Ids are 32-bit little-endian integers in one binary value per text.

Defined results: null text is empty (no ids); repeated rows give repeated results; an empty table gives an empty
table; a special token's string in a text becomes its id, as in the library. Result columns replace input columns of
the same name.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerline.llm.storage import ship

#: Words of up to so many bytes use the rank array.
SHORT = 256
#: Slots of the table of words (29 bytes each); it is emptied when more than half are taken, also within a text.
SLOTS = 1 << 20
#: Characters, or ids, that are worked on at a time.
BATCH_CHARS = 400_000

# Unicode white space, the pattern whose words the vocabulary is made for, and its contractions.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+"
           rf"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_NONE = 1 << 60
_SIGN, _LETTER, _NUMBER, _WHITE = range(4)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary file: itself if visible, else the next free one."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The kind of every code point: sign, letter, number or white space."""
    found = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_WHITE, f"[{WHITE}]+")):
        for run in regex.finditer(pattern, every):
            found[run.start():run.end()] = kind
    return found


def word_starts(chars: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where words start in ``chars`` (code points); ``texts`` are the places at which a text starts."""
    n = len(chars)
    kind = classes()[chars]
    first = np.zeros(n + 1, bool)
    first[texts] = True
    turn = first[:n].copy()
    turn[1:] |= kind[1:] != kind[:-1]
    start = np.append(turn, True)
    # White space before something visible gives up its last character, which joins the next word if it is a blank.
    after = np.flatnonzero(turn[1:] & (kind[:-1] == _WHITE) & ~first[1:n]) + 1
    start[after - 1] = True
    start[after] = chars[after - 1] != ord(" ")
    # A contraction is a word wherever a word would start with its apostrophe.
    marks = np.flatnonzero((chars == ord("'")) & start[:n])
    padded = np.append(chars, [0, 0, 0])
    last = np.append(first, [True, True, True])
    for ending in CONTRACTIONS:
        met = np.ones(len(marks), bool)
        for k, letter in enumerate(ending, 1):
            met &= (padded[marks + k] == ord(letter)) & ~last[marks + k]
        found = marks[met]
        start[found + 1] = False
        start[found + 1 + len(ending)] = True
    return np.flatnonzero(start[:n])


class WordTable:
    """Words of up to 23 bytes, as three 64-bit keys with the length in the last byte, and their ids in a pool."""

    def __init__(self, slots: int = SLOTS):
        self.slots = slots
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros((self.slots, 3), np.uint64)
        self.at = np.zeros(self.slots, np.int32)
        self.size = np.zeros(self.slots, np.uint8)
        self.pool = np.empty(0, np.uint32)
        self.taken = 0

    @staticmethod
    def keys_of(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """``data`` must go on for 24 bytes after the last word."""
        keys = np.empty((len(start), 3), np.uint64)
        windows = np.lib.stride_tricks.sliding_window_view(data, 8)
        masks = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
        for k in range(3):
            keys[:, k] = windows[start + 8 * k].view("<u8")[:, 0] & masks[np.clip(size - 8 * k, 0, 8)]
        keys[:, 2] |= size.astype(np.uint64) << np.uint64(56)
        return keys

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed = (mixed ^ keys[:, 1]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        mixed = (mixed ^ keys[:, 2]) * np.uint64(0x94D049BB133111EB)
        return ((mixed >> np.uint64(24)) & np.uint64(self.slots - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each word, or -1."""
        slot, found = self._slot(keys), np.full(len(keys), -1)
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.keys[slot]
            met = (held == keys[open_]).all(axis=1)
            found[open_[met]] = slot[met]
            go_on = ~met & (held[:, 2] != 0)
            open_, slot = open_[go_on], (slot[go_on] + 1) & (self.slots - 1)
        return found

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        """Take up words that are not in the table, each once."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.append(self.pool, np.frombuffer(b"".join(ids), np.uint32))
        slot, open_ = self._slot(keys), np.arange(len(keys))
        while len(open_):
            free = np.flatnonzero(self.keys[slot, 2] == 0)
            chosen, which = np.unique(slot[free], return_index=True)
            word = open_[free[which]]
            self.keys[chosen], self.at[chosen], self.size[chosen] = keys[word], at[word], sizes[word]
            rest = np.ones(len(open_), bool)
            rest[free[which]] = False
            open_, slot = open_[rest], slot[rest]
            slot = np.where(self.keys[slot, 2] == 0, slot, (slot + 1) & (self.slots - 1))
        self.taken += len(keys)


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        letters = byte_letters()
        bytes_of = {letter: byte for byte, letter in letters.items()}
        vocabulary: dict[str, int] = described["model"]["vocab"]
        self.byte_ids = [vocabulary[letters[b]] for b in range(256)]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, merge in enumerate(described["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks.setdefault(vocabulary[left] << 32 | vocabulary[right], rank)
            self.merged.append(vocabulary[left + right])
        self.special = {token["content"]: token["id"] for token in described["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        whole = vocabulary | self.special
        table = [b""] * (max(whole.values()) + 1)
        for token, number in whole.items():
            known = all(letter in bytes_of for letter in token)
            table[number] = bytes(bytes_of[x] for x in token) if known else token.encode()
        self.token_sizes = np.array(list(map(len, table)))
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)
        self._prepare_arrays()
        self.words = WordTable()

    def merge_long(self, word: bytes) -> list[int]:
        """Ids of a word of any length, by a heap of ranks over linked parts."""
        parts = [self.byte_ids[b] for b in word]
        known, merged, n = self.ranks, self.merged, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(known[key], i) for i in range(n - 1) if (key := parts[i] << 32 | parts[i + 1]) in known]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or known.get(parts[i] << 32 | parts[j]) != rank:
                continue  # a part of this pair has changed since
            parts[i], parts[j] = merged[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (key := parts[i] << 32 | parts[k]) in known:
                    heapq.heappush(heap, (known[key], i))
            if (h := before[i]) >= 0 and (key := parts[h] << 32 | parts[i]) in known:
                heapq.heappush(heap, (known[key], h))
        return [part for part in parts if part >= 0]

    def _prepare_arrays(self) -> None:
        """The rank table as sorted keys, for many words at a time."""
        keys = np.fromiter(self.ranks.keys(), np.int64, len(self.ranks))
        order = np.argsort(keys)
        self.sorted_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.sorted_ranks = np.append(np.fromiter(self.ranks.values(), np.int64, len(self.ranks))[order], _NONE)
        self.merged_ids = np.append(np.array(self.merged, np.int64), 0)
        self.first_ids = np.array(self.byte_ids, np.int64)
        self.first_ranks = self._ranks(np.repeat(self.first_ids, 256), np.tile(self.first_ids, 256)).reshape(256, 256)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.searchsorted(self.sorted_keys, keys)
        return np.where(self.sorted_keys[at] == keys, self.sorted_ranks[at], _NONE)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of many short words: each row of the arrays is one word's parts and ranks.

        Every round deletes one boundary in every row that still has a rank, so all rows shrink together.
        """
        found: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 6), (6, 10), (10, 16), (16, 24), (24, SHORT)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            if not len(rows):
                continue
            wide = int(sizes[rows].max())
            text = np.frombuffer(b"".join(words[r].ljust(wide, b"\0") for r in rows.tolist()), np.uint8)
            text = text.reshape(len(rows), wide)
            size = sizes[rows]
            parts = self.first_ids[text]
            ranks = np.where(np.arange(1, wide) < size[:, None], self.first_ranks[text[:, :-1], text[:, 1:]], _NONE)
            while len(rows):
                width = parts.shape[1]
                line = np.arange(len(rows))
                at = ranks.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
                least = ranks[line, at] if width > 1 else np.full(len(rows), _NONE)
                done = least == _NONE
                if done.any():
                    ids, step = parts[done].astype("<u4").tobytes(), 4 * width
                    for i, (row, n) in enumerate(zip(rows[done].tolist(), size[done].tolist())):
                        found[row] = ids[i * step:i * step + 4 * n]
                    left = ~done
                    rows, size, parts, ranks, at, least = (x[left] for x in (rows, size, parts, ranks, at, least))
                    if not len(rows):
                        break
                    line = np.arange(len(rows))
                parts[line, at] = self.merged_ids[least]
                column = np.arange(width - 1)
                parts = np.take_along_axis(parts, column + (column > at[:, None]), axis=1)
                column = np.arange(width - 2)
                ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), axis=1)
                size = size - 1
                before = np.flatnonzero(at > 0)
                ranks[before, at[before] - 1] = self._ranks(parts[before, at[before] - 1], parts[before, at[before]])
                after = np.flatnonzero(at < size - 1)
                ranks[after, at[after]] = self._ranks(parts[after, at[after]], parts[after, at[after] + 1])
        return found

    def _ids_of(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words at ``start`` in ``data``, one after the other, and the number of ids of each word.

        The words go through in steps, each of at most a quarter of the table's slots, so the table never fills up.
        """
        raw, ends, done = data.tobytes(), np.cumsum(size), 0
        ids, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        while done < len(start):
            stop = int(np.searchsorted(ends, (ends[done - 1] if done else 0) + BATCH_CHARS, "right"))
            stop = min(max(stop, done + 1), done + self.words.slots // 4)
            for held, found in zip((ids, counts), self._ids_of_step(data, raw, start[done:stop], size[done:stop])):
                held.append(found)
            done = stop
        return np.concatenate(ids), np.concatenate(counts)

    def _ids_of_step(self, data: np.ndarray, raw: bytes, start: np.ndarray,
                     size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that the table has room for once it is at most half full."""
        table = self.words
        if 2 * table.taken > table.slots:
            table.clear()
        short = np.flatnonzero(size < 24)
        keys = table.keys_of(data, start[short], size[short])
        found = table.find(keys)
        if (found < 0).any():
            new, which = np.unique(keys[found < 0], axis=0, return_index=True)
            rows = short[np.flatnonzero(found < 0)[which]]
            table.add(new, self.merge_many([raw[s:s + n] for s, n in zip(start[rows].tolist(), size[rows].tolist())]))
            found[found < 0] = table.find(keys[found < 0])
        counts = np.zeros(len(start), np.int64)
        counts[short] = table.size[found]
        places = np.zeros(len(start), np.int64)
        places[short] = table.at[found]
        pool = table.pool
        long = np.flatnonzero(size >= 24)
        if len(long):
            words = [raw[s:s + n] for s, n in zip(start[long].tolist(), size[long].tolist())]
            ids = self.merge_many(words)
            for i, word in enumerate(words):
                if len(word) > SHORT:
                    ids[i] = np.array(self.merge_long(word), np.uint32).tobytes()
            counts[long] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            places[long] = len(pool) + np.cumsum(counts[long]) - counts[long]
            pool = np.append(pool, np.frombuffer(b"".join(ids), np.uint32))
        ends = np.cumsum(counts)
        return pool[np.repeat(places - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)], counts

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        joined = "".join(texts)
        if not joined:
            return [b""] * len(texts)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(lengths) - lengths
        start = word_starts(chars, begin)
        width = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
        place = np.append(0, np.cumsum(width))
        data = np.frombuffer(joined.encode() + bytes(32), np.uint8)
        at = place[start]
        ids, counts = self._ids_of(data, at, np.diff(np.append(at, place[-1])))
        before = np.append(0, np.cumsum(counts))
        raw = ids.astype("<u4").tobytes()
        cuts = 4 * before[np.searchsorted(start, np.append(begin, len(chars)))]
        return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        return next(self.encode_many([text]))

    def encode_many(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text; about ``BATCH_CHARS`` are worked on at a time."""
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and size < BATCH_CHARS:
                size += len(texts[stop])
                stop += 1
            batch = texts[start:stop]
            split = {i: self._special.split(text) for i, text in enumerate(batch)
                     if any(name in text for name in self.special)}
            whole = iter(self._encode_plain([text for i, text in enumerate(batch) if i not in split]))
            for i in range(len(batch)):
                if i not in split:
                    yield next(whole)
                    continue
                plain = iter(self._encode_plain([part for part in split[i] if part not in self.special]))
                yield b"".join(self.special[part].to_bytes(4, "little") if part in self.special else next(plain)
                               for part in split[i])
            start = stop

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, dtype="<u4")
        sizes = self.token_sizes[numbers]
        ends = np.cumsum(sizes)
        take = np.repeat(self.token_starts[numbers] - ends + sizes, sizes)
        return self.token_bytes[take + np.arange(len(take))].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per vocabulary and Python worker."""
    return Codec(path)


def texts_of(column: pa.Array, most: int = 4 * BATCH_CHARS) -> Iterator[list[str]]:
    """The column's texts, null as empty, in lists of about ``most`` characters."""
    held, size = [], 0
    for value in column:
        text = value.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _with(schema: T.StructType, drop: set[str], *fields: T.StructField) -> T.StructType:
    gone = {f.name.lower() for f in fields} | drop
    return T.StructType([f for f in schema if f.name.lower() not in gone] + list(fields))


def encode(documents: DataFrame, path: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``ids`` (binary) and ``n_tokens`` to every row."""
    ship(documents.sparkSession)
    schema = _with(documents.schema, set() if keep_text else {text.lower()}, T.StructField("ids", T.BinaryType()),
                   T.StructField("n_tokens", T.LongType()))
    carried = [f.name for f in schema][:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        for batch in batches:
            at = 0
            for texts in texts_of(batch.column(text)):
                ids = list(known.encode_many(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(at, len(ids)) for c in carried]
                    + [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())],
                    names=[f.name for f in schema])
                at += len(ids)

    return documents.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, out: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """Add the text that ``ids`` stand for; null ids are an empty text."""
    ship(encoded.sparkSession)
    schema = _with(encoded.schema, set() if keep_ids else {"ids"}, T.StructField(out, T.StringType()))
    carried = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [known.decode(value.as_py() or b"") for value in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in carried] + [pa.array(texts, pa.string())],
                                                 names=[f.name for f in schema])

    return encoded.mapInArrow(run, schema)
