"""Personal data against plain Python."""

import hashlib
import math
import re
from collections import defaultdict

import duckdb
import pytest

from ledgerline.llm import pii
from ledgerline.llm.oracles import OP13

# The contract's expressions as they stand.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
BASE = {"email": EMAIL, "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
WORD = r"[^\W\d_]{3,}"


def luhn(d):
    return sum(x if i % 2 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(map(int, reversed(d)), 1)) % 10 == 0


def fits(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    return {"email": True, "ip": all(int(p) <= 255 for p in hit.split(".")) if kind == "ip" else 0,
            "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def plain(texts, rule=pii.Disclosure()):
    """{text: (base spans, added spans)}"""
    base, near = {}, defaultdict(set)
    docs_of, masked = defaultdict(set), {}
    for doc, text in enumerate(texts):
        base[text] = []
        masked[text] = re.sub(EMAIL, lambda m: " " * len(m[0]), text)
        for kind, pattern in BASE.items():
            hits = list(re.finditer(pattern, text))
            for i, m in enumerate(hits):
                if not fits(kind, m[0]):
                    continue
                base[text].append((kind, m.start(), m.end()))
                before = text[hits[i - 1].end() if i else 0:m.start()]
                after = text[m.end():hits[i + 1].start() if i + 1 < len(hits) else len(text)]
                left, right = before[-rule.near_chars:], after[:rule.near_chars]
                if len(before) > rule.near_chars:
                    left = re.sub(r"^[^\W\d_]+", " ", left)
                if len(after) > rule.near_chars:
                    right = re.sub(r"[^\W\d_]+$", " ", right)
                words = [re.findall(WORD, re.sub(EMAIL, " ", side).lower()) for side in (left, right)]
                words = words[0][-rule.near_words:] + words[1][:rule.near_words]
                key = re.sub("[^0-9]", "", m[0]) if kind in ("card", "phone") else m[0].lower()
                entity = f"{kind}:{key}"
                docs_of[entity].add(doc)
                for word in set(words):
                    near[entity, word].add((doc, " ".join(words)))
    holds = defaultdict(set)
    for doc, text in enumerate(texts):
        for word in re.findall(WORD, masked[text]):
            holds[word.lower()].add(doc)
    share, n = defaultdict(float), len(texts)
    for (entity, word), seen in near.items():
        if len({c for _, c in seen}) >= rule.least_contexts and len(docs_of[entity]) < n:
            joint = len({t for t, _ in seen})
            pmi = math.log2(n * joint / (len(holds[word]) * len(docs_of[entity])))
            share[word] = max(share[word], pmi / math.log2(n / len(docs_of[entity])))
    kinds = {w: "removed" if s >= rule.remove_at else "general" for w, s in share.items() if s >= rule.generalise_at}
    added = {t: sorted(((kinds[m[0].lower()], m.start(), m.end()) for m in re.finditer(WORD, mask)
                        if m[0].lower() in kinds), key=lambda s: (s[0] == "general", s[1])) for t, mask in masked.items()}
    return {t: (base[t], added[t]) for t in masked}


def row(doc_id, spans):
    base, added = spans
    text = lambda part: ",".join("%s:%d:%d" % s for s in part)
    return (doc_id, *(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(text(base).encode()).hexdigest(),
            text(base + added))


def check(spark, rows):
    known = plain([t or "" for _, t in rows])
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.digests(pii.scan(frame)).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[-1])
    expected = sorted((row(i, known[t or ""]) for i, t in rows), key=order)
    assert sorted((tuple(r) for r in found), key=order) == expected
    connection = duckdb.connect()
    connection.register("documents", frame.toArrow())
    assert sorted(connection.execute(OP13).fetchall(), key=order) == expected
    return known


ODD = [
    "a@b.co_d@e.fr x..y@z-.a.b., @a.b a@b a@@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 0255.01.1.1 1.2.3.4444 1.2.3", "4111 1111 1111 1111",
    "4111-1111-1111-1112 4111111111111111 41111111111111111111", "4 1 1 1-1 1 1 1-1 1 1 1-1 1 1 1, 12  34", "0000000000000 00000000000000000000",
    "+1 (743) 555-3824 +12 +123456789 +1234567890123456 ++1 2 3 4 5 6 7 8 9)", "é😀 jané@x.org 😀 10.0.0.1",
    "", None, "x" * 50, "a.b@c.d" * 5, "+1 5 +1 (2) 345 678 90 12.", "%@-.-", "12.34.56.78@mail.example.com",
]


def test_base_kinds(spark):
    known = check(spark, list(enumerate(ODD)) + [(3, ODD[3]), (None, ODD[0])])
    assert sum(len(base) for base, _ in known.values()) > 15


def people(n=6):
    """Texts in which a name always stands by an address, a place mostly, and common words anywhere."""
    rows = []
    for i in range(n):
        rows.append((i, f"Report {'abcdefgh'[i] * 3} by Lindqvist of Norrby, lindqvist@post.example and more {'hgfedcba'[i] * 4}"))
    rows += [(20 + i, f"common words of {'abcdefgh'[i] * 5} more and by number") for i in range(8)]
    rows += [(30, "from Norrby with care"), (31, "LINDQVIST and nobody else"), (32, "Lindqvists are others")]
    return rows


def test_revealing_words(spark):
    rows = people()
    known = check(spark, rows)
    kinds = {t[s:e].lower(): kind for t, (_, added) in known.items() for kind, s, e in added}
    assert kinds == {"lindqvist": "general", "norrby": "general", "report": "removed"}
    assert not any(known[t][1] for i, t in rows if 20 <= i < 30)


def test_copies_are_no_evidence(spark):
    text = "Report by Lindqvist of Norrby, lindqvist@post.example and more"
    rows = [(i, text) for i in range(20)] + [(50 + i, text + f" tail {i}" * 20) for i in range(9)] + [(99, "other words")]
    known = check(spark, rows)
    assert not any(added for _, added in known.values())


def test_sanitise(spark):
    rows = people()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(pii.scan(frame)).collect()}
    assert clean[0] == " aaa by [word] of [word], [email] and more hhhh"
    assert clean[31] == "[word] and nobody else" and clean[20] == rows[6][1]
    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    again = pii.sanitise(pii.scan(odd)).collect()
    assert {r.doc_id for r in again if r.text is None} == {9}
    assert next(r.text for r in again if r.doc_id == 7) == "é😀 jané@x.org 😀 [ip]"


@pytest.mark.parametrize("text, emails, ips", [
    ("a" * 300_000, 0, 0), ("1." * 150_000, 0, 37_500), ("1 " * 150_000, 0, 0), ("+1" + " " * 300_000, 0, 0),
    ("a@b." * 80_000, 40_000, 0), ("a@b.c " * 60_000, 60_000, 0), ("1.1.1.1 " * 40_000, 0, 40_000), ("9" * 300_000, 0, 0)])
def test_long_texts_take_linear_time(spark, text, emails, ips):
    assert len(re.findall(EMAIL, text)) == emails if "@" in text else not emails
    found = pii.digests(pii.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (found.n_email, found.n_ip) == (emails, ips)


def test_other_columns(spark):
    frame = spark.createDataFrame([(1, "a@b.cc", 7, "d", "m", 1.5)],
                                  "doc_id long, text string, pii int, digest string, mentions string, start double")
    found = pii.scan(frame).first()
    assert [tuple(s) for s in found.pii] == [(0, 6, "email")] and (found.digest, found.mentions, found.start) == ("d", "m", 1.5)
    assert pii.scan(frame.limit(0)).collect() == []


def test_native(spark):
    plan = pii.digests(pii.scan(spark.createDataFrame(people(), "doc_id long, text string")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan
