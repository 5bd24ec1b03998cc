import numpy as np
import pyarrow as pa
from brute import cosine_groups

from ledgerline.llm import embedding_dedup
from ledgerline.llm.embedding_dedup import Codes

SCHEMA = "vec_id long, embedding array<float>"


def vectors(seed=0, groups=30, size=8, dimension=64):
    rnd = np.random.default_rng(seed)
    found = []
    for _ in range(groups):
        base = rnd.standard_normal(dimension)
        found += [(base + rnd.standard_normal(dimension) * rnd.choice([0, 0.1, 0.2, 0.25])).astype(np.float32)
                  for _ in range(size)]
    found += [found[0] * np.float32(2)] + [found[5]] * 20
    table = {i: [float(x) for x in v] for i, v in enumerate(found)}
    n = len(table)
    return table | {n: None, n + 1: [0.0] * dimension, n + 2: [float("nan")] + [1.0] * (dimension - 1), n + 3: [],
                    n + 4: [None] + [1.0] * (dimension - 1), n + 5: [float("inf")] * dimension, n + 6: [1.0, 2.0],
                    n + 7: [2.0, 4.0]}


def got(spark, table, **more):
    frame = spark.createDataFrame(list(table.items()), SCHEMA).repartition(3)
    rows = embedding_dedup.deduplicate(frame, **more).collect()
    assert len(rows) == len(table)
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return {r.vec_id: (r.n_links, r.component_id) for r in rows}


def test_same_as_all_pairs(spark):
    table = vectors()
    assert got(spark, table) == cosine_groups(table)


def test_large_buckets(spark):
    table = vectors(1, groups=3, size=40)
    assert got(spark, table, codes=Codes(block=8)) == cosine_groups(table)


def test_estimates_are_unbiased_and_bounded():
    rnd = np.random.default_rng(3)
    base = rnd.standard_normal(64)
    units = np.stack([base + rnd.standard_normal(64) * s for s in np.linspace(0, 3, 400)])
    units /= np.linalg.norm(units, axis=1)[:, None]
    errors, outside = [], 0
    for seed in range(10):
        guess, bound = embedding_dedup.estimates(units, Codes(seed=seed))
        error = guess - units @ units.T
        off = ~np.eye(len(units), dtype=bool)
        errors.append(error[off].mean())
        outside += (np.abs(error) > bound[:, None])[off].sum()
    assert abs(np.mean(errors)) < 0.01
    assert outside == 0


def test_codes_come_back_as_stored():
    units = np.random.default_rng(5).standard_normal((50, 33))
    units /= np.linalg.norm(units, axis=1)[:, None]
    codes = Codes().sized(10**6)
    stored = embedding_dedup.encode(units, codes)
    back = embedding_dedup.Stored.unpacked(stored.packed(), 33, codes)
    assert (back.levels == stored.levels).all() and (back.slices == stored.slices).all()
    assert np.allclose([back.factor, back.step, back.rest], [stored.factor, stored.step, stored.rest], atol=1e-6)
    assert np.abs(stored.levels).max() == 15 and (np.abs(stored.levels) % 2 == 1).all()


def test_pairs_on_the_threshold_are_met_and_left_to_the_exact_step():
    rnd = np.random.default_rng(6)
    for dimension, vectors in ((16, 10**4), (64, 10**6), (384, 10**9)):
        a, b = rnd.standard_normal((2, 2000, dimension))
        a /= np.linalg.norm(a, axis=1)[:, None]
        b -= (a * b).sum(axis=1)[:, None] * a
        b = 0.9501 * a + np.sqrt(1 - 0.9501**2) * b / np.linalg.norm(b, axis=1)[:, None]
        codes = Codes().sized(vectors)
        keys = [embedding_dedup.slice_keys(embedding_dedup.encode(x, codes).slices, codes) for x in (a, b)]
        assert (keys[0] == keys[1]).any(axis=1).sum() >= 1996
        stored = embedding_dedup.encode(np.vstack([a[:300], b[:300]]), codes)
        i, j = embedding_dedup.surviving(stored, 0, None, codes)
        assert ((j - i) == 300).sum() == 300


def test_estimates_rule_out_most_pairs():
    units = np.random.default_rng(8).standard_normal((1000, 64))
    units /= np.linalg.norm(units, axis=1)[:, None]
    stored = embedding_dedup.encode(units, Codes())
    assert len(embedding_dedup.surviving(stored, 0, None, Codes())[0]) < 20


def test_lengths_that_share_a_bucket(spark):
    rows = [embedding_dedup.CODED, [0, 0, 0, 0, 0, 1, 1, 2, b""], [0, 0, 0, 0, 0, 2, 1, 65_538, b""]]
    whole = pa.table({c: [r[k] for r in rows[1:]] for k, c in enumerate(rows[0])})
    assert [t.num_rows for t in embedding_dedup._of_one_size(whole)] == [1, 1]
    small = {0: [1.0, 2.0], 1: [2.0, 4.0], 4: [1.0, 2.1], 5: [1.0, 2.0, 0.0]}
    assert got(spark, small) == cosine_groups(small)


def test_odd_rows(spark):
    frame = spark.createDataFrame([(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 2), (5, [1.0, 0.0], 3), (9, [2.0, 0.0], 4)],
                                  "vec_id long, embedding array<double>, kept int")
    rows = embedding_dedup.deduplicate(frame).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id) for r in rows if r.vec_id is not None) == [
        (5, 2, 5), (5, 2, 5), (9, 2, 5)]
    assert [(r.n_links, r.component_id, r.kept) for r in rows if r.vec_id is None] == [(0, None, False)]
    assert embedding_dedup.deduplicate(frame.limit(0)).collect() == []
