"""Quality rules (10): fixed base rules, then adaptive fences from quantile sketches per language and source.

Every document is measured once, with SQL functions only. Three shares (symbols, repeated lines, repeated three-word
windows, in thousandths) and the mean length of a word (in tenths of a character, up to 100 characters) of the documents
that the base rules accept go into quantile sketches on a fixed grid: a count per bin, at most 1001 bins for each
language, source and measure. Such a sketch merges by adding counts, gives every rank exactly and every value to a
thousandth, and does not depend on the order of merging, so a retried task cannot change a verdict (KLL sketches
compact at random and would). A group that is too small for quantiles of its own uses the merged sketch of its
language, then the one of all documents. The fences follow two quantiles of the group (``FENCES``) and are joined to the
measured rows. Length in words gets no fence: a long document is not a bad one, and the base rules set the least.

Defined results: null text is empty (no words, so ``base_failed``); null language or source is a group of its own;
repeated rows are judged one by one; equal values are on the same side of a fence; an empty table gives an empty table;
other columns pass through, but those named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.columns import SPACE, let, text_of, total, words_of
from ledgerline.llm.storage import settle

SHARES = ("symbol_share", "dup_line_share", "repeat_share", "word_length")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A fence table up to this size is broadcast (about 60 bytes a row); a larger one is joined by shuffle.
BROADCAST_GROUPS = 100_000


@dataclass(frozen=True)
class Fence:
    """``share`` is too high beyond ``high + reach * max(high - low, least)``, where low and high are its quantiles (in
    thousandths) in the group; a fence of both sides also has the lower bound ``low - reach * max(high - low, least)``."""

    share: str
    low: int
    high: int
    reach: int
    least: int
    both_sides: bool = False


#: Symbols and word lengths vary in every document, so quartiles tell their spread. Most documents repeat nothing, so
#: the spread of repeats lies between the median and the twentieth part that repeats most.
FENCES = (
    Fence("symbol_share", 250, 750, 4, 10),
    Fence("dup_line_share", 500, 950, 4, 25),
    Fence("repeat_share", 500, 950, 4, 25),
    Fence("word_length", 250, 750, 4, 5, both_sides=True),
)


@dataclass(frozen=True)
class Fences:
    """The fences, and the number of documents that a group needs for quantiles of its own."""

    each: tuple[Fence, ...] = FENCES
    least_documents: int = 200


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are compared by a 64-bit hash within one text. After sorting by hash, a repeated window has an equal
    neighbour; the starts of repeated windows in order then tell how many positions they cover.
    """

    def windows(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(ws) - 3)
        return F.array_sort(F.transform(starts, lambda i: F.struct(
            F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i"))))

    def repeated(ordered: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            return (F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False))
                    | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)))
        return F.array_sort(F.transform(F.filter(ordered, twin), lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        return total(F.transform(starts, lambda start, i: F.least(
            F.lit(3), F.coalesce(F.get(starts, i + 1) - start, F.lit(3)))))

    return let(words, lambda ws: F.when(
        F.size(ws) >= 3, let(windows(ws), lambda w: let(repeated(w), covered))).otherwise(F.lit(0).cast("long")))


def measure(content: Column) -> dict[str, Column]:
    """Word, line and symbol counts of a text column, as columns to add in one narrow pass."""
    words = let(words_of(content), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n"), _repeat_words(ws).alias("r")))
    lines = let(F.filter(F.split(content, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")), lambda ls: F.struct(
        F.size(ls).cast("long").alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("d")))
    return {"words": words, "lines": lines,
            "word_chars": (F.char_length(content) - F.regexp_count(content, F.lit(SPACE))).cast("long"),
            "n_symbols": F.regexp_count(content, F.lit(r"[#*$%&|<>]")).cast("long")}


def measured(documents: DataFrame, by: list[str], text: str = "text", keep_text: bool = True) -> DataFrame:
    """``doc`` (the row as it came), ``g0``, ``g1``, ... (the group), ``MEASURES``, ``SHARES`` and ``base_failed``."""
    carried = [c for c in documents.columns if keep_text or c != text]
    return (
        documents
        .select(F.struct(*carried).alias("doc"), text_of(text).alias("content"),
                *[F.col(c).alias(f"g{i}") for i, c in enumerate(by)])
        .withColumns(measure(F.col("content")))
        .withColumns({"n_words": F.col("words.n"), "n_repeat_words": F.col("words.r"), "n_dup_lines": F.col("lines.d")})
        .withColumns({
            "symbol_share": F.expr("1000 * n_symbols div greatest(word_chars, 1)"),
            "dup_line_share": F.expr("1000 * n_dup_lines div greatest(lines.n, 1)"),
            "repeat_share": F.expr("1000 * n_repeat_words div greatest(n_words, 1)"),
            "word_length": F.expr("least(10 * word_chars div greatest(n_words, 1), 1000)"),
            "base_failed": F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")})
        .drop("content", "words", "lines")
    )


def sketches(measured: DataFrame, by: list[str]) -> DataFrame:
    """One row per group, share and bin with its count; adding the counts of equal bins merges sketches."""
    pairs = F.array(*[F.struct(F.lit(name).alias("share"), F.col(name).alias("bin")) for name in SHARES])
    return measured.select(*by, F.inline(pairs)).groupBy(*by, "share", "bin").agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "share", "bin").agg(F.sum("n").alias("n"))


def _quantiles(sketch: DataFrame, by: list[str], each: tuple[Fence, ...] = FENCES) -> DataFrame:
    """Group, share, documents and the two quantiles of its fence (smallest bin that holds the rank)."""
    # A window has at most 1001 rows: the bins of one sketch.
    group = Window.partitionBy(*by, "share")
    running = F.sum("n").over(group.orderBy("bin"))

    def of_share(parameter: str) -> Column:
        return F.create_map(*[F.lit(x) for f in each for x in (f.share, getattr(f, parameter))])[F.col("share")]

    def quantile(parameter: str) -> Column:
        return F.min(F.when(1000 * F.col("_at") >= of_share(parameter) * F.col("_all"), F.col("bin"))).alias(parameter)

    return (sketch.withColumns({"_at": running, "_all": F.sum("n").over(group)})
            .groupBy(*by, "share").agg(F.max("_all").alias("documents"), quantile("low"), quantile("high")))


def fences(sketch: DataFrame, by: list[str], rule: Fences = Fences()) -> DataFrame:
    """The lowest and highest accepted values per group, from its own quantiles or those of a merged sketch if it is small.

    ``by`` runs from the widest to the narrowest column (language, source).
    """
    levels = [_quantiles(merge(sketch, by[:depth]), by[:depth], rule.each) for depth in range(len(by), -1, -1)]
    keys = sketch.select(*by, "share").distinct()
    chosen = keys
    for number, (level, depth) in enumerate(zip(levels, range(len(by), -1, -1))):
        named = level.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by[:depth])],
                             F.col("share").alias("_share"),
                             F.when((F.col("documents") >= rule.least_documents) | F.lit(depth == 0),
                                    F.struct("low", "high")).alias(f"_q{number}"))
        same = F.col("share") == F.col("_share")
        for i, c in enumerate(by[:depth]):
            same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        chosen = chosen.join(named, same, "left").drop("_share", *[f"_k{i}" for i in range(depth)])
    quantiles = F.coalesce(*[F.col(f"_q{number}") for number in range(len(levels))])

    def limit(fence: Fence, end: str, sign: int) -> Column:
        spread = F.greatest(F.col("_q.high") - F.col("_q.low"), F.lit(fence.least).cast("long"))
        return F.max(F.when(F.col("share") == fence.share, F.col(f"_q.{end}") + sign * fence.reach * spread))

    return (chosen.withColumn("_q", quantiles).groupBy(*by)
            .agg(*[limit(f, "high", 1).alias(f"max_{f.share}") for f in rule.each],
                 *[limit(f, "low", -1).alias(f"min_{f.share}") for f in rule.each if f.both_sides]))


def judge(documents: DataFrame, by: tuple[str, ...] = ("lang", "source"), rule: Fences = Fences(),
          text: str = "text", keep_text: bool = True) -> DataFrame:
    """All rows with their measures, ``base_failed`` and ``kept``; these names replace input columns of the same name.

    The measured rows are written once, because both the sketches and the join read them.
    """
    groups = [f"g{i}" for i in range(len(by))]
    rows = settle(measured(documents, list(by), text, keep_text), "measured")
    limits = settle(fences(sketches(rows.where("NOT base_failed"), groups), groups, rule), "fences")
    few = limits.count() <= BROADCAST_GROUPS
    limits = limits.withColumnsRenamed({g: f"of_{g}" for g in groups})
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    within = ~F.col("base_failed")
    for fence in rule.each:
        within = within & (F.col(fence.share) <= F.col(f"max_{fence.share}"))
        if fence.both_sides:
            within = within & (F.col(fence.share) >= F.col(f"min_{fence.share}"))
    results = {*MEASURES, "base_failed", "kept"}
    # A group without limits has no document that the base rules accept.
    return (rows.join(F.broadcast(limits) if few else limits, same, "left")
            .withColumn("kept", within)
            .select(*[F.col("doc")[c].alias(c) for c in rows.schema["doc"].dataType.names if c.lower() not in results],
                    *MEASURES, "base_failed", "kept"))
