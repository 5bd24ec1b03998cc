import random

import numpy as np
import pytest
from brute import jaccard_groups

from ledgerline.llm import ngram_join
from ledgerline.llm.ngram_join import Bounds, Likeness

SCHEMA = "doc_id long, text string"


def near_copies(seed, clusters=12, size=9):
    """Texts with exact and near copies, shared passages, short texts and chains of edits."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choices(vocabulary, k=30))
    texts = []
    for c in range(clusters):
        base = rnd.choices(vocabulary, k=rnd.choice([3, 6, 20, 60, 150]))
        if c % 3 == 0:
            base = base + passage.split()
        for k in range(size):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append((" " if k % 2 else "\n").join(copy).upper() if k % 4 == 0 else " ".join(copy))
            base = copy if c % 4 == 1 else base
    texts += [passage] * 5 + ["", None, " \t", "one", "One", "one two", "one two three four five"]
    rnd.shuffle(texts)
    return dict(enumerate(texts))


def got(spark, documents, **more):
    rows = ngram_join.join(spark.createDataFrame(list(documents.items()), SCHEMA).repartition(3), **more).collect()
    assert len(rows) == len(documents)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_all_pairs(spark, seed):
    documents = near_copies(seed)
    expected, links = jaccard_groups(documents)
    assert len(links) > 50
    assert got(spark, documents) == expected


def test_groups_beyond_the_bounds(spark):
    documents = near_copies(3, clusters=4, size=30)
    expected, _ = jaccard_groups(documents)
    assert got(spark, documents, bounds=Bounds(sets=6, shingles=10_000)) == expected


@pytest.mark.parametrize("together", [2, 5])
def test_shingles_with_very_many_documents(spark, together):
    documents = near_copies(6, clusters=5, size=25)
    expected, _ = jaccard_groups(documents)
    assert got(spark, documents, bounds=Bounds(together=together)) == expected


def test_sketches_never_rule_out_a_link():
    rnd = random.Random(9)
    like = Likeness()
    for size in (3, 60, 900, 1100, 3000):
        base = [rnd.getrandbits(64) for _ in range(size)]
        sets = []
        for _ in range(8):
            copy = set(base[:rnd.randint(int(size * 0.85), size)]) | {rnd.getrandbits(64) for _ in range(rnd.randint(0, size // 9))}
            sets.append(np.array(sorted(copy), np.uint64))
        flat, owner = ngram_join._flat(sets)
        sizes = np.array(list(map(len, sets)))
        maps = ngram_join.sketches(flat, owner, sizes)
        edges, labels = ngram_join.plausible(np.arange(8), sizes, maps, np.ones(8, bool), like)
        for a in range(8):
            for b in range(a):
                overlap = len(np.intersect1d(sets[a], sets[b]))
                assert not like.linked(overlap, sizes[a] + sizes[b]) or labels[a] == labels[b]


def test_other_similarity(spark):
    documents = near_copies(4, clusters=6)
    expected, _ = jaccard_groups(documents, least=50)
    assert got(spark, documents, like=Likeness(least=50)) == expected


def test_shared_tables(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 500")
    documents = {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}
    expected, _ = jaccard_groups(documents)
    rows = ngram_join.join(frame).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected


def test_trie_finds_every_link():
    rnd = random.Random(5)
    like = Likeness()
    for _ in range(60):
        base = rnd.sample(range(1000), rnd.choice([1, 5, 30]))
        sets = [np.unique(np.array([x if rnd.random() > 0.06 else rnd.randrange(1000) for x in base], np.uint64))
                for _ in range(12)]
        trie = ngram_join.Trie(sets, like)
        for probe in range(len(sets)):
            labels = np.arange(len(sets))
            found = {trie.member[i] for i in trie.links(probe, labels)}
            own = set(sets[trie.member[probe]].tolist())
            expected = {i for i, s in enumerate(sets) if i != trie.member[probe] and
                        100 * len(own & set(s.tolist())) >= 80 * len(own | set(s.tolist()))}
            assert found == expected


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, "x " * 50_000),
            (4, None)]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, component_id string")
    found = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.join(frame).collect()
                   if r.doc_id is not None)
    assert found == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 3), (4, 0, 4)]
    assert [r.component_id for r in ngram_join.join(frame).where("doc_id IS NULL").collect()] == [None]
    assert ngram_join.join(frame.limit(0)).collect() == []

def random_sets(rnd, sizes):
    return [np.unique(np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64)) for n in sizes]


def test_unrelated_sets_are_ruled_out():
    sets = random_sets(random.Random(11), [1024] * 150 + [2048] * 50)
    sizes = np.array(list(map(len, sets)))
    maps = ngram_join.sketches(*ngram_join._flat(sets), sizes)
    edges, labels = ngram_join.plausible(np.arange(len(sets)), sizes, maps, np.ones(len(sets), bool), Likeness())
    assert edges == [] and len(np.unique(labels)) == len(sets)


@pytest.mark.parametrize("seed", range(6))
def test_every_asked_pair_is_looked_at(seed):
    rnd, like = random.Random(seed), Likeness()
    sets = []
    for base in random_sets(rnd, [480, 520, 1000, 1050]):
        for _ in range(12):
            keep = rnd.random() * 0.3 + 0.7
            sets.append(np.array(sorted({int(x) for x in base if rnd.random() < keep} |
                                        {rnd.getrandbits(64) for _ in range(rnd.randint(0, 60))}), np.uint64))
    rnd.shuffle(sets)
    sizes = np.array(list(map(len, sets)))
    maps = ngram_join.sketches(*ngram_join._flat(sets), sizes)
    for asks in (np.ones(len(sets), bool), np.array([rnd.random() < 0.2 for _ in sets]), np.arange(len(sets)) == 7):
        edges, labels = ngram_join.plausible(np.arange(100, 100 + len(sets)), sizes, maps, asks, like)
        assert len(edges) == len(sets) - len(np.unique(labels))
        for a in range(len(sets)):
            for b in range(a):
                overlap = len(np.intersect1d(sets[a], sets[b]))
                if (asks[a] or asks[b]) and like.linked(overlap, int(sizes[a] + sizes[b])):
                    assert labels[a] == labels[b]


def test_a_set_that_links_with_nothing_does_not_walk_the_trie():
    rnd = random.Random(4)
    base = random_sets(rnd, [400])[0]
    sets = [np.unique(np.append(base[rnd.sample(range(400), 390)], random_sets(rnd, [10])[0])) for _ in range(60)]
    sets.append(np.unique(np.append(base[rnd.sample(range(400), 330)], random_sets(rnd, [70])[0])))

    class Counted(list):
        read = 0

        def __getitem__(self, k):
            Counted.read += 1
            return super().__getitem__(k)

    trie = ngram_join.Trie(sets, Likeness())
    trie.nodes = Counted(trie.nodes)
    assert list(trie.links(trie.member.index(60), np.arange(61))) == [] and Counted.read == 0
    assert len(list(trie.links(trie.member.index(0), np.arange(61)))) == 59


@pytest.mark.parametrize("batch,together", [(1, 4096), (3, 4096), (7, 4)])
def test_shingles_that_span_batches(spark, batch, together):
    documents = near_copies(8, clusters=4)
    expected, _ = jaccard_groups(documents)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(batch))
    try:
        assert got(spark, documents, bounds=Bounds(together=together)) == expected
    finally:
        spark.conf.set(setting, before)


def test_copies_are_sent_once(spark):
    text, other = "a b c d e f g h", "q r s t u v"
    rows = [(9, text), (2, text.upper()), (5, text), (5, other), (4, other), (None, text), (7, ""), (8, None), (1, "z")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(4)
    sets = ngram_join.measure(docs, Likeness()).where("NOT counted").drop("counted")
    stands, copies = ngram_join.copies_of(sets)
    assert sorted(r.id for r in stands.collect()) == [1, 2, 4]
    assert sorted(map(tuple, copies.collect())) == [(2, 5), (2, 9), (4, 5)]
    left, skip = ngram_join.spared(docs, stands, copies)
    assert skip.tolist() == [5, 9]
    order = ngram_join.Order(np.empty(0, np.uint64), np.empty(0, np.int8))
    assert ngram_join.postings(left, skip, order, Likeness(), 10).collect() == []


def test_very_many_copies_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_COPIES", 0)
    documents = near_copies(12, clusters=4)
    expected, _ = jaccard_groups(documents)
    assert got(spark, documents) == expected
