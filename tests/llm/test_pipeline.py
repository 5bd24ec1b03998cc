"""The pipeline against a plain version of every stage."""

import sys
import os

import numpy as np
import public_tokenizers
from brute import jaccard_groups
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from ledgerline.llm import quality, secret_scan  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "n-gram Jaccard join", "secret scans", "packing"]
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    first = stages["quality rules"](spark, documents, SF_DIR)
    assert first.schema.simpleString() == documents.schema.simpleString()
    kept = {r.doc_id for r in quality.judge(documents).where("kept").collect()}
    rows = {r.doc_id: r for r in first.collect()}
    assert set(rows) == kept and 0 < len(kept) < documents.count()

    second = stages["n-gram Jaccard join"](spark, first, SF_DIR)
    groups, links = jaccard_groups({i: r.text for i, r in rows.items()})
    left = {r.doc_id: r for r in second.collect()}
    assert set(left) == {i for i, (_, component) in groups.items() if i == component}
    assert links and len(left) < len(rows)

    third = stages["secret scans"](spark, second, SF_DIR)
    assert third.columns == documents.columns
    clean = {r.doc_id: r for r in third.collect()}
    assert set(clean) == set(left)
    found = {r.doc_id: r.spans for r in secret_scan.digests(secret_scan.scan(second)).collect()}
    for i, r in clean.items():
        assert (r.text == left[i].text) == (found[i] == "")
        assert r.n_chars == len(r.text)
    assert all(r.spans == "" for r in secret_scan.digests(secret_scan.scan(third)).collect())

    pieces = stages["packing"](spark, third, SF_DIR).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in clean.values())
    assert sum(p.length for p in pieces) == total
    assert {p.doc_id for p in pieces} == set(clean)

    whole = corpus_pipeline.run(spark, SF_DIR).collect()
    key = lambda p: (p.doc_id, p.doc_tokens)
    assert sorted({key(p) for p in whole}) == sorted({key(p) for p in pieces})
    assert np.sum([p.length for p in whole]) == total


def test_repeated_and_null_rows(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text + " more", "en", "s", 1), (None, text, "en", "s", 1),
            (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF_DIR)
    assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 1, 1]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF_DIR)
    assert empty.collect() == []


def test_columns_of_any_name(spark):
    rows = [(1, "password=hunter2hunter2", "en", "s", 23, "mine", True, 7.5), (2, "clean", "en", "s", 5, None, False, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "secrets string, _changed boolean, `rest` double")
    out = dict(corpus_pipeline.STAGES)["secret scans"](spark, docs, SF_DIR)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert sorted(map(tuple, out.collect())) == [(1, "[assign]", "en", "s", 8, "mine", True, 7.5), rows[1]]
