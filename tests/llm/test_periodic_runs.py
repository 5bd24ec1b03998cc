"""Periodic runs against a plain search over all lags."""

import hashlib
import random
import zlib

import numpy as np
from brute import words
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import periodic_runs
from ledgerline.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plain_runs(w):
    """All lags, all diagonals; a run whose words also have a smaller period is dropped."""
    found = []
    for q in range(1, len(w) // 3 + 1):
        start = None
        for i in range(q, len(w) + 1):
            same = i < len(w) and w[i] == w[i - q]
            if same and start is None:
                start = i
            if not same and start is not None:
                if i - start + q >= max(24, 3 * q):
                    found.append((start - q, i - start + q, q))
                start = None
    return sorted((r for r in found if not any(
        o[2] < r[2] and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1] for o in found)), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def numbers(values):
    return np.array(values, np.int32)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=14), st.integers(1, 9)), max_size=7))
def test_random_repetitions(parts):
    w = [x for block, times in parts for x in block * times]
    assert periodic_runs.runs_of(numbers(w)) == plain_runs(w)


def test_nested_and_structured_sequences():
    draw = random.Random(1)
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    inner = ([1, 2] * 20 + [3]) * 5
    cases = [fibonacci[-1], [bin(i).count("1") % 2 for i in range(512)], inner, inner[7:] + inner, [0] * 300,
             [0] * 23, [0] * 24, list(range(8)) * 3, list(range(8)) * 3 + [0], list(range(100)) * 2, list(range(50)) * 3,
             [], [1], [draw.randint(0, 1) for _ in range(500)], ([5] * 40 + [6]) * 4]
    for w in cases:
        assert periodic_runs.runs_of(numbers(w)) == plain_runs(w)


def test_long_texts_of_one_word_and_of_long_periods():
    n = 1_000_000
    assert periodic_runs.runs_of(np.zeros(n, np.int32)) == [(0, n, 1)]
    block = np.random.default_rng(2).integers(0, 50, 200_000).astype(np.int32)
    assert periodic_runs.runs_of(np.concatenate([block] * 4)) == [(0, 800_000, 200_000)]


def test_words_are_cut_like_the_pattern():
    text = "a\x0bb\x0cc\td\re\nf  g h i\x1cj \x85k "
    found, known = periodic_runs.numbered(text.encode())
    assert [known[i].decode() for i in found] == words(text)
    long = "word " * 500_000
    found, known = periodic_runs.numbered(long.encode())
    assert len(found) == 500_000 and known == [b"word"]


def test_rows(spark):
    base = " ".join(f"w{i}" for i in range(30))
    rows = [(i, " ".join([base] * (i % 5 + 1)) + " tail") for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n "), (63, "x " * 50), (63, "x " * 50), (None, base + " " + base + " " + base)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = periodic_runs.digests(periodic_runs.scan(periodic_runs.planted(frame), keep_text=False)).collect()
    known = [plain_row(i, t) if i is not None else (None, *plain_row(0, t)[1:]) for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in found), key=key) == sorted(known, key=key)
    assert periodic_runs.digests(periodic_runs.scan(frame.limit(0))).collect() == []


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "x " * 30, 5, "c", "r")], "doc_id long, text string, start long, collapsed string, runs string")
    row = periodic_runs.scan(frame).first()
    assert row.start == 5 and row.collapsed == "x" and [tuple(r) for r in row.runs] == [(0, 30, 1)]


def test_query(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    found = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SF_DIR).collect()}
    assert found == {d.doc_id: plain_row(d.doc_id, d.text) for d in documents}
    assert any(row[1] > 1 for row in found.values())
