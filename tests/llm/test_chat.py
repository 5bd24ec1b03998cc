import hashlib
import random
import re

import pytest

from ledgerline.llm import chat
from ledgerline.llm.queries import HOSTILE

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    found = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        n, turns, loss = found.get(conv, (0, "", ""))
        found[conv] = (n + 1, turns + f"{role or ''}\n{text or ''}\n", loss + ((text or "") if role == "assistant" else ""))
    return {conv: (n, sha(turns), len(loss), sha(loss)) for conv, (n, turns, loss) in found.items()}


def got(spark, rows, **more):
    turns = chat.format_turns(spark.createDataFrame(rows, SCHEMA).repartition(3), **more)
    found = chat.digests(turns).collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found}


def rows_of(seed=0):
    rnd = random.Random(seed)
    pieces = ["### ", "Assistant: ", "</turn>", "\\", "#", "<", "a", "é", "\n", " ", ":", "###", "user", "b", "\U0001f600"]
    rows = []
    for conv in range(40):
        for turn in range(rnd.choice([1, 2, 5, 30])):
            role = rnd.choice(["user", "assistant", "system", "to: ol", "", None])
            rows.append((conv, turn, role, rnd.choice([None, "", "".join(rnd.choices(pieces, k=rnd.randint(1, 12)))])))
    return rows + [(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)]


def test_round_trip(spark):
    assert got(spark, rows_of()) == expected(rows_of())


@pytest.mark.parametrize("context", [2, 3, 100])
def test_context_does_not_matter(spark, context):
    assert got(spark, rows_of(1), context=context) == expected(rows_of(1))


def test_spans_are_the_formatted_texts(spark):
    rows = [r for r in rows_of(2) if r[1] < 5]
    turns = chat.format_turns(spark.createDataFrame(rows, SCHEMA)).collect()
    whole = {}
    for t in turns:
        whole[t.conv_id] = whole.get(t.conv_id, "") + t.piece
    texts = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        texts.setdefault(conv, []).append((role or "", text or ""))
    for conv, messages in texts.items():
        assert whole[conv] == chat.plain_turns(messages)
        spans = [t for t in turns if t.conv_id == conv]
        assert [chat.unescape(whole[conv][t.text_start:t.text_end]) for t in spans] == [text for _, text in messages]
        assert not any(t.rewrites for t in spans)


def test_escaping_is_reversible():
    rnd = random.Random(7)
    for _ in range(3000):
        text = "".join(rnd.choices(["\\", "#", "##", "###", "<", "</turn>", "</", "turn>", "x", ":", " "], k=8))
        for role in (False, True):
            escaped = chat.escape(text, role)
            assert chat.unescape(escaped) == text
            plain = re.sub(r"\\(\\|###|</turn>|:)", "_", escaped)
            assert not any(mark in plain for mark in ("\\", "###", "</turn>"))


def test_templates_that_rewrite_are_found():
    def no_thoughts(messages):  # earlier thoughts go once another turn follows
        return "".join(f"[{r}]{t if i == len(messages) - 1 else t.split('|')[-1]};" for i, (r, t) in enumerate(messages))

    def last_marked(messages):
        return "".join(f"<{r}>{t}" for r, t in messages) + "<end>"

    for render in (no_thoughts, last_marked):
        state = chat.Incremental(render)
        for turn in [("user", "hi"), ("assistant", "think|yes"), ("user", "and?")]:
            state.add(*turn)
        assert state.rewrites

    state = chat.Incremental(chat.plain_turns)
    for k in range(50):
        state.add("user", f"text {k}")
    assert not state.rewrites


def test_odd_rows(spark):
    frame = spark.createDataFrame([(None, 1, "user", "x", "y"), (3, None, "assistant", "q", "y"),
                                   (3, 2, "assistant", "long " * 100_000, "y"), (3, 2, "assistant", "long " * 100_000, "y")],
                                  SCHEMA + ", piece string")
    rows = {r.conv_id: r for r in chat.digests(chat.format_turns(frame)).collect()}
    assert rows[None].n_turns == 1 and rows[3].n_turns == 3 and rows[3].loss_chars == 1_000_001
    assert chat.digests(chat.format_turns(frame.limit(0))).collect() == []


def added(render, count, **more):
    state = chat.Incremental(render, **more)
    return state, [state.add(("user", "assistant")[i % 2], f"text {i}") for i in range(count)]


def test_template_that_keeps_the_last_ten_turns():
    state, _ = added(lambda messages: chat.plain_turns(messages[-10:]), 10)
    assert not state.rewrites
    state, _ = added(lambda messages: chat.plain_turns(messages[-10:]), 11)
    assert state.rewrites


def test_template_that_numbers_turns_or_needs_the_first():
    def numbered(messages):
        first = messages[0][0] if messages else ""
        return "".join(f"[{i} after {first}] {role}: {text}\n" for i, (role, text) in enumerate(messages))

    state, pieces = added(numbered, 40)
    assert not state.rewrites
    whole = [(("user", "assistant")[i % 2], f"text {i}") for i in range(40)]
    assert "".join(piece for piece, *_ in pieces) == numbered(whole)
    assert [piece[a:b] for piece, a, b in pieces] == [text for _, text in whole]
    assert added(chat.plain_turns, 1)[0].context == chat.CONTEXT


def test_all_rows_of_a_rewritten_conversation_are_marked(spark):
    def last_ten(messages):
        return chat.plain_turns(messages[-10:])

    rows = [(conv, turn, ("user", "assistant")[turn % 2], f"text {conv} {turn}")
            for conv, turns in ((1, 10), (2, 25), (None, 11), (4, 3)) for turn in range(turns)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    turns = chat.format_turns(frame, last_ten).collect()
    assert len(turns) == len(rows)
    assert {t.conv_id: None for t in turns if t.rewrites}.keys() == {2, None}
    assert all(t.rewrites for t in turns if t.conv_id in (2, None))
    assert not any(t.loss for t in turns if t.rewrites)
    assert sum(t.loss for t in turns) == 5 + 1


def test_declared_context_is_not_trusted(spark):
    def numbered(messages):
        return "".join(f"[{i}] {role}: {text}\n" for i, (role, text) in enumerate(messages))

    rows = [(1, turn, "assistant", f"text {turn}") for turn in range(12)] + [(2, 0, "assistant", "only")]
    turns = chat.format_turns(spark.createDataFrame(rows, SCHEMA), numbered, context=4).collect()
    assert {(t.conv_id, t.rewrites, t.loss) for t in turns} == {(1, True, False), (2, False, True)}
