"""Personal data (13): fixed kinds, and words whose co-occurrence with them in the corpus gives them away.

Four base kinds are found by expressions and checks (parts of an address, Luhn's sum, number of digits). What they find
are the protected entities: an e-mail address in lower case, the digits of a card or phone number, an IP address.
Removing them alone is not enough where other words reveal them, so in the manner of information-theoretic
sanitisation a word is judged by what the corpus says:

* the information of an entity is ``IC(e) = log2(N / df(e))``, and what word ``t`` reveals of it is their pointwise
  mutual information, ``PMI(t, e) = log2(N * df(t, e) / (df(t) * df(e)))``, with ``N`` and ``df`` counting
  documents; ``df(t, e)`` counts those that have ``t`` near ``e`` (within ``near_words`` words and ``near_chars``
  characters, up to the next match of the same kind), which keeps the evidence linear in the mentions;
* a word that reveals at least ``remove_at`` of some entity's information is a ``removed`` span wherever it stands, one
  that reveals at least ``generalise_at`` a ``general`` span. ``least_contexts`` different surroundings must show word
  and entity together: copies of a text, and edited copies with the same surroundings, are no evidence.

Words are runs of at least three letters, compared in lower case, outside e-mail addresses. SQL functions only; counts
are grouped by entity, word or both after map-side aggregation, and nothing nests more than one text holds.

Spans count code points, the end is exclusive; per kind they are the leftmost non-overlapping matches, of which those
that fail the check are dropped. Defined results: null text is empty and has no spans; rows with null or repeated ids
are judged one by one, by their text alone; texts of any length are read whole in linear time; an empty table gives an
empty table. Result columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.columns import let, located, replaced, text_of
from ledgerline.llm.storage import settle

#: Tables of up to so many rows (some 100 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Disclosure:
    """When words near an entity count as revealing it."""

    near_words: int = 6
    near_chars: int = 80
    least_contexts: int = 3
    remove_at: float = 0.95
    generalise_at: float = 0.8


@dataclass(frozen=True)
class Kind:
    """Matches of ``pattern`` that are ``valid``; ``entity`` is what equal entities have in common."""

    name: str
    pattern: str
    entity: Callable[[Column], Column]
    valid: Callable[[Column], Column] | None = None


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _parts_fit(hit: Column) -> Column:
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
    return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _luhn(hit: Column) -> Column:
    """13 to 19 digits, whose sum is a multiple of ten if every second one from the right is doubled."""

    def doubled(digit: Column) -> Column:
        return 2 * digit - F.when(digit > 4, 9).otherwise(0)

    def checksum(number: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), lambda sum_, i: sum_ + let(
            F.substring(number, F.char_length(number) - i + 1, F.lit(1)).cast("int"),
            lambda digit: F.when(i % 2 == 0, doubled(digit)).otherwise(digit)))

    return let(digits(hit), lambda number: F.when(
        F.char_length(number).between(13, 19), checksum(number) % 10 == 0).otherwise(False))


# The expressions are those of the contract, with possessive quantifiers and no start inside a run that has failed
# already, so that no text takes quadratic time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
KINDS = (
    Kind("email", EMAIL, F.lower),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda hit: hit, _parts_fit),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", digits, _luhn),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", digits, lambda hit: F.char_length(digits(hit)).between(9, 15)),
)
#: What the method adds, after the base kinds.
REMOVED, GENERAL = "removed", "general"
WORD = r"\p{L}{3,}"

_SPAN = "array<struct<start:int,end:int,kind:string>>"
_MENTION = "array<struct<entity:string,words:array<string>>>"


def _near(match: Column, rule: Disclosure) -> Column:
    """The words on both sides of a match, in order."""

    def words(gap: Column, side: Column, cut: str) -> Column:
        # A word that the limit cuts in two is none.
        whole = F.when(F.char_length(gap) > rule.near_chars, F.regexp_replace(side, cut, " ")).otherwise(side)
        return F.regexp_extract_all(F.lower(F.regexp_replace(whole, EMAIL, " ")), F.lit(WORD), F.lit(0))

    reach, most = F.lit(rule.near_chars), rule.near_words
    before = words(match["before"], F.right(match["before"], reach), r"^\p{L}+")
    after = words(match["after"], F.left(match["after"], reach), r"\p{L}+$")
    return F.concat(let(before, lambda w: F.slice(w, F.greatest(F.size(w) - most, F.lit(0)) + 1, most)),
                    F.slice(after, 1, most))


def mentioned(documents: DataFrame, text: str, keep_text: bool, rule: Disclosure) -> DataFrame:
    """``doc`` (the row as it came), ``digest`` of its text, ``base`` spans in order, and ``mentions`` (entity, words)."""
    carried = [c for c in documents.columns if keep_text or c.lower() != text.lower()]
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("doc"), text_of(f"`{text}`").alias("content"))
    rows = rows.withColumn("digest", F.sha2("content", 256)).withColumns(
        {kind.name: located(F.col("content"), kind.pattern, kind.valid) for kind in KINDS})

    def spans(kind: Kind) -> Column:
        return F.coalesce(F.transform(kind.name, lambda m: F.struct(
            m["start"], m["end"], F.lit(kind.name).alias("kind"))), F.array().cast(_SPAN))

    def mentions(kind: Kind) -> Column:
        return F.coalesce(F.transform(kind.name, lambda m: F.struct(
            F.concat(F.lit(kind.name + ":"), kind.entity(m["hit"])).alias("entity"),
            _near(m, rule).alias("words"))), F.array().cast(_MENTION))

    return rows.select("doc", "digest", F.concat(*map(spans, KINDS)).alias("base"),
                       F.concat(*map(mentions, KINDS)).alias("mentions"))


def _masked(content: Column) -> Column:
    """The text with blanks in place of e-mail addresses, the one kind that holds letters."""

    def blank(hits: Column, pieces: Column) -> Column:
        return F.concat(F.array_join(F.transform(hits, lambda hit, i: F.concat(
            F.get(pieces, i), F.repeat(F.lit(" "), F.char_length(hit)))), ""), F.get(pieces, F.size(hits)))

    return F.when(F.contains(content, F.lit("@")), let(
        F.regexp_extract_all(content, F.lit(EMAIL), F.lit(0)),
        lambda hits: let(F.split(content, EMAIL, -1), lambda pieces: blank(hits, pieces)))).otherwise(content)


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def words_in(masked: str) -> Column:
    """The different words of a text."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(masked, F.lit(WORD), F.lit(0))), F.lower))


def revealing(rows: DataFrame, texts: DataFrame, rule: Disclosure) -> DataFrame:
    """(word, kind) of the words that reveal an entity.

    ``rows`` are those of :func:`mentioned`; ``texts`` has the column ``masked``.
    """
    seen = F.flatten(F.transform("mentions", lambda m: let(F.sha2(F.concat_ws(" ", m["words"]), 256), lambda context:
                     F.transform(m["words"], lambda word: F.struct(
                         m["entity"].alias("entity"), word.alias("word"), context.alias("context"))))))
    pairs = F.transform(seen, lambda x: F.struct(x["entity"].alias("entity"), x["word"].alias("word")))
    both = rows.select(F.inline(F.array_distinct(pairs))).groupBy("entity", "word").agg(F.count(F.lit(1)).alias("both"))
    shown = rows.select(F.inline(F.array_distinct(seen))).distinct().groupBy("entity", "word").agg(
        F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= rule.least_contexts)
    entities = rows.select(F.explode(F.array_distinct("mentions.entity")).alias("entity")).groupBy("entity").agg(
        F.count(F.lit(1)).alias("df_entity"))
    together = settle(both.join(shown, ["entity", "word"]).join(entities, "entity").select(
        "entity", "word", "both", "df_entity"), "together")
    words = texts.select(F.explode(words_in("masked")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df_word"))
    n = F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")))  # one row
    pmi = F.log2(F.col("n") * F.col("both") / (F.col("df_word") * F.col("df_entity")))
    share = F.when(F.col("df_entity") < F.col("n"), pmi / F.log2(F.col("n") / F.col("df_entity")))
    scored = words.join(_small(together), "word").crossJoin(n).groupBy("word").agg(F.max(share).alias("share"))
    return settle(scored.where(F.col("share") >= rule.generalise_at).select(
        "word", F.when(F.col("share") >= rule.remove_at, REMOVED).otherwise(GENERAL).alias("kind")), "revealing-words")


def scan(documents: DataFrame, text: str = "text", rule: Disclosure = Disclosure(), keep_text: bool = True) -> DataFrame:
    """Every row with ``pii``: an array of (start, end, kind), the base kinds in order, then the words that reveal."""
    rows = settle(mentioned(documents, text, keep_text, rule), "mentioned")
    content = text_of(f"`{text}`")
    texts = documents.select(F.sha2(content, 256).alias("digest"), _masked(content).alias("masked"))
    words = revealing(rows, texts, rule)
    # One list for each text that holds such words; no longer than its different words.
    holders = texts.select("digest", F.explode(words_in("masked")).alias("word")).join(_small(words), "word")
    lists = settle(holders.groupBy("digest").agg(F.map_from_entries(F.collect_set(F.struct("word", "kind"))).alias(
        "kinds")), "texts-with-words")

    def named(kinds: Column, masked: Column) -> Column:
        spans = F.transform(located(masked, WORD, lambda hit: F.map_contains_key(kinds, F.lower(hit))), lambda m: F.struct(
            m["start"], m["end"], F.element_at(kinds, F.lower(m["hit"])).alias("kind")))
        return F.concat(F.filter(spans, lambda s: s["kind"] == REMOVED), F.filter(spans, lambda s: s["kind"] == GENERAL))

    added = settle(texts.join(_small(lists), "digest").select("digest", named(F.col("kinds"), F.col("masked")).alias(
        "added")).dropDuplicates(["digest"]), "added-spans")
    joined = rows.join(_small(added), "digest", "left")
    carried = [F.col("doc")[c].alias(c) for c in rows.schema["doc"].dataType.names if c.lower() != "pii"]
    return joined.select(*carried, F.concat("base", F.coalesce("added", F.array().cast(_SPAN))).alias("pii"))


def sanitise(scanned: DataFrame, text: str = "text") -> DataFrame:
    """Texts in which entities become their kind in brackets, revealing words go, and less revealing ones become general."""
    ordered = F.array_sort("pii")
    mark = lambda span: F.when(span["kind"] == REMOVED, F.lit("")).otherwise(
        F.concat(F.lit("["), F.when(span["kind"] == GENERAL, F.lit("word")).otherwise(span["kind"]), F.lit("]")))
    clean = F.when(F.size("pii") > 0, let(ordered, lambda spans: replaced(text_of(f"`{text}`"), spans, mark)))
    return scanned.withColumn(text, F.coalesce(clean, F.col(f"`{text}`"))).drop("pii")


def digests(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as text."""
    kinds = [kind.name for kind in KINDS]

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(key, *map(count, kinds), F.sha2(listed(F.filter(
        "pii", lambda s: s["kind"].isin(kinds))), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
