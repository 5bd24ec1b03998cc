"""Column helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that separates words: blank and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda word: word != "")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda sum_, value: sum_ + value)


def fresh(frame: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name if the table has a column of that name already."""
    taken = {name.lower() for name in frame.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """``combine`` over each value and all before it, in ``n log n`` steps: every round reaches twice as far back."""

    def reach(so_far: Column, back: Column) -> Column:
        return F.transform(so_far, lambda value, i: F.when(
            i >= back, combine(F.get(so_far, i - back), value)).otherwise(value))

    rounds = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int")),
                         lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.when(F.size(values) > 1, F.aggregate(rounds, values, reach)).otherwise(values)


def located(text: Column, pattern: str, valid: Callable[[Column], Column] | None = None) -> Column:
    """The leftmost non-overlapping matches that are ``valid``: (start, end, hit, and the text before and after it up to
    the next match). Code points, end exclusive; null if there are none. Linear in the text and (but for a logarithm)
    in the matches."""

    def placed(hits: Column, pieces: Column) -> Column:
        steps = F.transform(hits, lambda hit, i: F.char_length(F.get(pieces, i)) + F.char_length(hit))
        return let(running(steps, lambda a, b: a + b), lambda ends: F.transform(hits, lambda hit, i: F.struct(
            (F.get(ends, i) - F.char_length(hit)).alias("start"), F.get(ends, i).alias("end"), hit.alias("hit"),
            F.get(pieces, i).alias("before"), F.get(pieces, i + 1).alias("after"))))

    def found(hits: Column) -> Column:
        every = let(F.split(text, pattern, -1), lambda pieces: placed(hits, pieces))
        if valid is None:
            return F.when(F.size(hits) > 0, every)
        return F.when(F.exists(hits, valid), F.filter(every, lambda m: valid(m["hit"])))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


#: Code points that a text is cut into to be sliced.
CHUNK = 1000


def replaced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """``text`` with each run of overlapping spans (ordered by start) replaced by ``mark`` of its first span.

    Pieces are taken from chunks of the text, so the work is linear in the text and the spans.
    """

    def slice_of(chunks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / CHUNK).cast("int")
        several = F.slice(chunks, first + 1, F.floor(F.greatest(end - 1, start) / CHUNK).cast("int") - first + 1)
        return F.substring(F.array_join(several, ""), start % CHUNK + 1, end - start)

    def rebuilt(chunks: Column, ends: Column) -> Column:
        before = F.transform(spans, lambda span, i: F.struct(
            F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("from"), span.alias("span")))
        heads = F.filter(before, lambda x: x["span"]["start"] >= x["from"])
        parts = F.transform(heads, lambda x: F.concat(
            slice_of(chunks, x["from"], x["span"]["start"]), mark(x["span"])))
        last = F.get(ends, F.size(ends) - 1)
        return F.concat(F.array_join(parts, ""), slice_of(chunks, last, F.char_length(text)))

    ends = running(F.transform(spans, lambda span: span["end"]), F.greatest)
    whole = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)),
                lambda chunks: let(ends, lambda e: rebuilt(chunks, e)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
