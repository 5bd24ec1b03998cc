"""Chat formatting (4): incremental rendering with a black-box template.

``render(messages)`` is any function from a list of (role, text) to a string. Successive prefixes of a conversation are
rendered and consecutive outputs compared: what the output gained is the turn's span. Where the text lies inside its
span is found by rendering the turn with two probe texts, which differ only where the text goes. A template that does
not leave its earlier output alone is detected: all rows of the conversation are marked ``rewrites`` and carry no loss
span, also those of turns before the one at which it shows.

By default true prefixes are rendered: a worker holds the conversation it is at and its last output, and the work grows
with the square of the turns. A template that is declared to render each turn on its own (``turn_local``, as the default
one, or a ``context``) is rendered from a sliding context of a few turns, so the work grows with the turns. When the
context is cut, the last turn's piece must come out as before; if it does not, the template is not what was declared
and its conversation is marked likewise.

Rows are dealt out by conversation, sorted by turn, and streamed. Conversations are rendered twice: once to find those
that the template rewrites, whose ids are then joined to the rows, and once to put the turns out, so no conversation is
held until its last turn is known. A function that carries the mark ``turn_local`` itself (as the default template, which
puts out one line per turn and nothing else) is not rendered for that; if the mark is wrong, rows are marked from the
turn on at which it shows.

Defined results: null text or role is empty; a null conversation id is a conversation of its own; rows of one turn number
are ordered by role and text, and repeated rows stay; an empty table gives an empty table. Other columns are not read and
may have any name. Texts of any length are rendered whole, in a few copies.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.storage import settle, ship

Message = tuple[str, str]
Render = Callable[[list[Message]], str]

#: Turns kept for rendering the next one with a template whose turns do not depend on each other.
CONTEXT = 8

OPEN, CLOSE, HEAD = "### ", " </turn>\n", ": "
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")


def escape(text: str, role: bool = False) -> str:
    """A backslash before every control string and every backslash."""
    return (_ROLE_CONTROL if role else _CONTROL).sub(lambda found: "\\" + found[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda found: found[1], text)


def plain_turns(messages: list[Message]) -> str:
    """The default template: ``### role: text </turn>`` on a line for each turn."""
    return "".join(f"{OPEN}{escape(role, True)}{HEAD}{escape(text)}{CLOSE}" for role, text in messages)


#: A template with this mark renders each turn on its own.
plain_turns.turn_local = True


class Incremental:
    """Renders one conversation turn by turn: all turns so far, or the last ones if a ``context`` is given.

    A context is right only for templates whose turns do not depend on their number or on turns before it.
    """

    def __init__(self, render: Render, context: int | None = None):
        if context is None and getattr(render, "turn_local", False):
            context = CONTEXT
        self.render, self.context = render, context and max(2, context)
        self.kept: list[Message] = []
        self.before = render([])
        self.rewrites = False

    def add(self, role: str, text: str) -> tuple[str, int, int]:
        """What the output gains by this turn, and where the turn's text starts and ends in it."""
        if self.context and len(self.kept) >= self.context:
            self._cut()
        after = self.render([*self.kept, (role, text)])
        if not after.startswith(self.before):
            self.rewrites = True
            self.kept, self.before = [], self.render([])
            after = self.render([(role, text)])
        piece = after[len(self.before):]
        start, end = self._locate(role, text, piece)
        self.kept.append((role, text))
        self.before = after
        return piece, start, end

    def _cut(self) -> None:
        """Go on with half of the context, if the template renders its last turn as before."""
        kept = self.kept[-(self.context // 2):]
        short = self.render(kept)
        last = self.before[len(self.render(self.kept[:-1])):]
        if not short.endswith(last):
            self.rewrites = True
        self.kept, self.before = kept, short

    def _locate(self, role: str, text: str, piece: str) -> tuple[int, int]:
        """Ends that two renderings with unlike texts share are the template's."""
        a, b = (self.render([*self.kept, (role, probe)])[len(self.before):] for probe in ("a", "b"))
        n = min(len(a), len(b))
        head = next((i for i in range(n) if a[i] != b[i]), n)
        tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
        if len(piece) < head + tail or piece[:head] != a[:head] or tail and piece[-tail:] != a[-tail:]:
            self.rewrites = True
            return 0, 0
        return head, len(piece) - tail


def rewritten(turns: DataFrame, render: Render, context: int | None = None) -> DataFrame:
    """(conv_id) of the conversations whose earlier output the template does not leave alone; ``turns`` has (conv_id,
    role, text), in order inside each partition, which holds whole conversations."""
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for batch in batches:
            found = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if conv != current:
                    current, state = conv, Incremental(render, context)
                if not state.rewrites:
                    state.add(role, text)
                    if state.rewrites:
                        found.append(conv)
            yield pa.RecordBatch.from_arrays([pa.array(found, batch.schema.field(0).type)], names=["conv_id"])

    return turns.mapInArrow(run, schema)


def format_turns(conversations: DataFrame, render: Render = plain_turns, context: int | None = None,
                 trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn, in order inside each partition: conv_id, first (starts a conversation), turn_start and
    turn_end in the formatted conversation, text_start, text_end, loss (the text is trained on), piece, rewrites."""
    ship(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {kind}, first boolean, turn_start bigint, "
              "turn_end bigint, text_start bigint, text_end bigint, loss boolean, piece string, rewrites boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, at = object(), None, 0
        for batch in batches:
            rows = []
            for conv, role, text, known in zip(*(batch.column(i).to_pylist() for i in range(4))):
                first = conv != current
                if first:
                    current, state, at = conv, Incremental(render, context), 0
                    at = len(state.before)
                piece, start, end = state.add(role, text)
                rewrites = known or state.rewrites
                rows.append((conv, first, at, at + len(piece), at + start, at + end,
                             role in trained and not rewrites, piece, rewrites))
                at += len(piece)
            columns = list(zip(*rows)) if rows else [[]] * 9
            types = [batch.schema.field(0).type, pa.bool_(), *[pa.int64()] * 4, pa.bool_(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             names=["conv_id", "first", "turn_start", "turn_end", "text_start",
                                                    "text_end", "loss", "piece", "rewrites"])

    def ordered(rows: DataFrame) -> DataFrame:
        return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role, text)
    if getattr(render, "turn_local", False):
        rows = rows.withColumn("known", F.lit(False))
    else:
        found = settle(rewritten(ordered(rows).select("conv_id", "role", "text"), render, context), "rewritten")
        rows = (rows.join(found.select(F.col("conv_id").alias("found"), F.lit(True).alias("known")),
                          F.col("conv_id").eqNullSafe(F.col("found")), "left").drop("found")
                .withColumn("known", F.coalesce("known", F.lit(False))))
    return ordered(rows).select("conv_id", "role", "text", "known").mapInArrow(run, schema)


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted turns of the default template: number and digest of the turns,
    characters and digest of the text under the loss mask, characters of the whole."""
    schema = (f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, n_turns bigint, turns_sha256 string, "
              "loss_chars bigint, loss_sha256 string, formatted_chars bigint")

    class Digest:
        """Hashes that run along with a conversation of any length."""

        def __init__(self, conv):
            self.conv, self.n, self.loss_chars, self.chars = conv, 0, 0, 0
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, piece: str, start: int, end: int, loss: bool) -> None:
            text = unescape(piece[start:end])
            role = unescape(piece[len(OPEN):start - len(HEAD)])
            self.turns.update(f"{role}\n{text}\n".encode())
            if loss:
                self.loss.update(text.encode())
                self.loss_chars += len(text)
            self.n += 1
            self.chars += len(piece)

        def row(self) -> tuple:
            return (self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kind = None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind, rows = batch.schema.field(0).type, []
            for conv, first, begin, start, end, loss, piece in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if first:
                    if current is not None:
                        rows.append(current.row())
                    current = Digest(conv)
                current.add(piece, start - begin, end - begin, loss)
            yield out(rows)
        if current is not None:
            yield out([current.row()])

    return (turns.select("conv_id", "first", "turn_start", "text_start", "text_end", "loss", "piece")
            .mapInArrow(run, schema))
