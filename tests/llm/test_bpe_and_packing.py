import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def own_ids(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in bpe.codec(PATH).encode_many(texts)]


def odd_texts(seed, count):
    rnd = random.Random(seed)
    pieces = [*"ab1 '\n\t  \x1c\x85\xa0é。", "<|endoftext|>", "'re", "'ll", "'S", "  ", "the", "ü", "\U0001f600", "x" * 30, "　", ""]
    return ["".join(rnd.choices(pieces, k=rnd.randint(0, 25))) for _ in range(count)]


def test_every_code_point():
    texts = [f"a {chr(c)}b1{chr(c)} {chr(c)}{chr(c)}  x" for c in range(0x110000)
             if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 41 == 0)]
    for text, ids in zip(texts, own_ids(texts)):
        assert ids == library_ids(text), repr(text)


def test_odd_texts_and_round_trip():
    texts = odd_texts(1, 6000)
    for text, ids in zip(texts, own_ids(texts)):
        expected = library_ids(text)
        assert ids == expected, repr(text)
        packed = np.array(ids, "<u4").tobytes()
        assert bpe.codec(PATH).decode(packed) == LIBRARY.decode(expected, skip_special_tokens=False)


@pytest.mark.parametrize("length", [1, 22, 23, 24, 255, 256, 257, 5000])
def test_long_words(length):
    rnd = random.Random(length)
    texts = ["".join(rnd.choices(letters, k=length)) for letters in ("ab", "x", "th", "qwertyuiop", "äö", "=-", " ", "\n ")]
    assert own_ids(texts) == [library_ids(text) for text in texts]


def test_table_of_words_that_fills_up():
    table = bpe.WordTable(slots=64)
    small = bpe.Codec(PATH)
    small.words = table
    texts = [f"word{i} other{i * 7} {'z' * (i % 30)}" for i in range(300)]
    got = [np.frombuffer(x, "<u4").tolist() for text in texts for x in small.encode_many([text])]
    assert got == [library_ids(text) for text in texts]


def test_one_text_with_more_words_than_the_table_has_slots():
    small = bpe.Codec(PATH)
    small.words = bpe.WordTable(slots=64)
    text = " ".join(f"{i} w{i * 7} {'y' * (i % 40)}" for i in range(500))
    assert np.frombuffer(small.encode(text), "<u4").tolist() == library_ids(text)


def test_one_text_of_many_different_numbers():
    text = " ".join(map(str, range(1_500_000)))
    assert np.array_equal(np.frombuffer(bpe.codec(PATH).encode(text), "<u4"), np.array(library_ids(text), "<u4"))


def test_ids_that_are_no_text():
    ids = np.array([50_000, 128, 50_256, 3], "<u4")
    assert bpe.codec(PATH).decode(ids.tobytes()) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_frames(spark):
    rows = [(1, "Hello  there", "a"), (2, None, "b"), (2, "", "c"), (3, "long " * 60_000, "d"), (None, "x", "e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(2)
    encoded = bpe.encode(frame, PATH)
    assert encoded.columns == ["doc_id", "text", "ids", "n_tokens"]
    for r in bpe.decode(encoded, PATH).collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library_ids(r.text or "")
        assert r.decoded == (r.text or "") and r.n_tokens == len(library_ids(r.text or ""))
    assert bpe.decode(bpe.encode(frame.limit(0), PATH), PATH).collect() == []


def check_packing(documents, pieces, window):
    """Every id in exactly one piece, windows without gaps, all but the last full."""
    by_window, by_document = {}, {}
    for p in pieces:
        by_window.setdefault(p.sequence_id, []).append(p)
        by_document.setdefault(p.doc_id, []).append(p)
    for number, own in by_window.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == window or number == max(by_window) and at <= window
    assert sorted(by_window) == list(range(len(by_window)))
    assert set(by_document) == set(documents)
    for doc_id, text in documents.items():
        ids = np.array([*library_ids(text or ""), 1], "<u4")
        at = 0
        for p in sorted(by_document[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


@pytest.mark.parametrize("window", [1, 7, 64, 2048])
def test_packing(spark, window):
    documents = dict(enumerate([*odd_texts(2, 150), None, "", "word " * 3000]))
    frame = spark.createDataFrame(list(documents.items()), "doc_id long, text string").repartition(5)
    check_packing(documents, packing.pack(frame, PATH, window=window).collect(), window)


def test_sequences(spark):
    documents = dict(enumerate(odd_texts(3, 40)))
    frame = spark.createDataFrame(list(documents.items()), "doc_id long, text string").repartition(3)
    pieces = packing.pack(frame, PATH, window=64, with_ids=True)
    rows = {r.sequence_id: r for r in packing.sequences(pieces, window=64, pad_id=9).collect()}
    total = sum(len(library_ids(t)) + 1 for t in documents.values())
    assert sum(r.n_tokens for r in rows.values()) == total and len(rows) == -(-total // 64)
    for r in rows.values():
        power = r.n_tokens & (r.n_tokens - 1) == 0
        assert len(r.ids) == 4 * (r.n_tokens if power else 64)
    ends = sum(np.frombuffer(bytes(r.ids), "<u4")[:r.n_tokens].tolist().count(1) for r in rows.values())
    assert ends >= len(documents)


def test_packing_odd_tables(spark):
    frame = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (None, None, 5)], "doc_id long, text string, start int")
    assert packing.pack(frame, PATH).agg(F.sum("length")).first()[0] == 5
    assert packing.pack(frame.limit(0), PATH).collect() == []
