"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from ledgerline.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_paths(rows, rebuild):
    """{conv_id: [(role, text), ...]}"""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(
        turns, key=lambda x: (x[0], x[1], x[2], prefix_digest(x[2], x[3])))] for c, turns in own.items()}
    if not rebuild:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def prefix_digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32] + f":{len(text.encode())}"


def plain_trie(paths):
    members = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = {p: 0 for p in members}, {p: 0 for p in members}
    for p, ids in members.items():
        worth = (len(ids) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += worth
    out = set()
    for p, ids in members.items():
        ends = sorted(c for c in ids if len(paths[c]) == len(p))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.add((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), children[p], leaves[p], saved[p], digest))
    return out


def found(spark, rows, rebuild=True, hot_rows=10**6):
    turns = prefix_trie.numbered(spark.createDataFrame(rows, SCHEMA), hot_rows)
    paths, members = (prefix_trie.rebuilt if rebuild else prefix_trie.as_they_are)(turns)
    nodes = prefix_trie.digests(*prefix_trie.trie(paths, members, hot_rows)).select(*prefix_trie.NODE, "ends_sha256")
    got = [tuple(r) for r in nodes.collect()]
    assert len(got) == len(set(got))
    return set(got)


def conversations(draw, n, longest, texts):
    rows = []
    for c in range(n):
        for t in range(draw.randint(1, longest)):
            rows.append((c, t, draw.choice(["user", "assistant"]) if t % 7 else "user", draw.choice(texts)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("rebuild", [True, False])
def test_short_and_long(spark, rebuild):
    draw = random.Random(3)
    rows = conversations(draw, 60, 9, ["a", "bé", ""]) + [(100 + c, t, "user", "same") for c in range(6) for t in range(25 + c % 3)]
    rows += [(200, t, "user", "same" if t < 20 else f"x{t}") for t in range(40)]
    assert found(spark, rows, rebuild) == plain_trie(plain_paths(rows, rebuild))


def test_hot_conversations_are_split(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 16)
    rows = [(5, t, "user", f"w{t % 4}") for t in range(300)] + [(6, t, "user", f"w{t % 4}") for t in range(150)]
    rows += [(c, t, "user", f"w{t % 4}") for c in range(10, 20) for t in range(c - 8)]
    assert found(spark, rows, hot_rows=40) == plain_trie(plain_paths(rows, True))


def test_nulls_ties_turnless_and_missing_bases(spark):
    # The first h turns of 1, 2 and 4 come from 0, which has one turn; 7's base is absent, so its first turns are gone.
    rows = [(0, 0, "user", "hi"), (1, 0, None, None), (1, 1, "user", ""), (2, None, "user", "x"), (2, 0, "user", "x"),
            (4, 3, "b", "t"), (4, 3, "a", "t"), (4, 3, "a", "t"), (7, 0, "user", "only"), (None, 0, "user", "nobody"),
            (-3, 1, "user", "hi")]
    known = plain_trie(plain_paths([r for r in rows if r[0] is None or r[0] >= 0], True))
    assert found(spark, [r for r in rows if r[0] is None or r[0] >= 0]) == known
    assert any(row[1] == 0 and row[3] == 5 for row in known)
    whole = plain_trie(plain_paths(rows, False))
    assert found(spark, rows, rebuild=False) == whole


def test_only_turnless_and_empty(spark):
    lonely = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    known = plain_trie({lonely: []})
    assert found(spark, [(lonely, 0, "user", "gone")]) == known
    assert found(spark, []) == set()


def test_other_columns_may_clash(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a", 9, 9, "z")],
                                  SCHEMA + ", depth long, block long, path string")
    nodes, ends = prefix_trie.scan(frame)
    assert sorted((r.conv_id, r.depth, r.n_convs) for r in nodes.collect()) == [(1, 0, 1), (1, 1, 1)]
    assert [tuple(r) for r in ends.collect()] == [(1, 1, 1)]
