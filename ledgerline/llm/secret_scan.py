"""Secret scans (1): trigram inverted index, Boolean trigram queries, verification of candidates.

A Boolean query is derived from each rule's regular expression: an AND of clauses, each an OR of literal strings that
the expression must contain, each string an AND of its trigrams. One narrow pass builds the postings (trigram,
document) of every trigram that some query names, over whole lower-cased texts. Joining the postings with the queries'
terms and counting per document intersects them. Only candidates are verified with the expression itself; a rule
without mandatory trigrams has every document as candidate. SQL functions only.

Spans count code points, the end is exclusive; per rule they are the leftmost non-overlapping matches, of which those
with a too short value are dropped. Positions come from splitting a text at the matches and adding up lengths, in time linear in the text and,
but for a logarithm, in the matches.

Defined results: null text is empty and has no spans; a null ``doc_id`` is a key of its own; repeated rows give
repeated results; an empty table gives an empty table. Result columns replace input columns of the same name.
"""

from __future__ import annotations

import itertools
import re._parser as regex_parser
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.columns import let, located, replaced, text_of
from ledgerline.llm.storage import settle

#: A candidate table of up to this many rows (some 60 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_CANDIDATES = 500_000
#: A trigram query keeps at most so many alternatives together, and spells out classes of up to so many letters.
MOST_STRINGS, MOST_LETTERS = 64, 8


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose ``group`` is shorter than ``least`` are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + \
    either_case("key")

#: The three base rules. A run of one class is as long as it gets, so its least length can stand in the pattern.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Rules beyond the base.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("hosting_token", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

Clause = frozenset[frozenset[str]]


def trigrams(literal: str) -> frozenset[str]:
    return frozenset(literal[i:i + 3] for i in range(len(literal) - 2))


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses that all hold for any lower-cased text with a match; no clause means that every text must be read."""
    clauses: list[Clause] = []

    def spelled(item) -> set[str] | None:
        """All lower-cased strings that one parsed item matches, if they are few."""
        kind, value = item
        kind = str(kind)
        if kind == "LITERAL":
            return {chr(value).lower()}
        if kind == "IN":
            letters = set()
            for what, x in value:
                if str(what) == "LITERAL":
                    letters.add(chr(x).lower())
                elif str(what) == "RANGE" and x[1] - x[0] < MOST_LETTERS:
                    letters |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
            return letters if len(letters) <= MOST_LETTERS else None
        if kind == "MAX_REPEAT" and value[1] <= 1:
            inner = product(value[2])
            return inner and ({""} if value[0] == 0 else set()) | inner
        if kind == "SUBPATTERN":
            return product(value[3])
        if kind == "BRANCH":
            parts = [product(branch) for branch in value[1]]
            return None if None in parts else set().union(*parts)
        return None

    def product(items) -> set[str] | None:
        strings = {""}
        for item in items:
            part = spelled(item)
            if part is None or len(strings) * len(part) > MOST_STRINGS:
                return None
            strings = {a + b for a, b in itertools.product(strings, part)}
        return strings

    def close(strings: set[str]) -> None:
        if all(len(s) >= 3 for s in strings):
            clauses.append(frozenset(map(trigrams, strings)))

    strings = {""}
    for item in regex_parser.parse(pattern):
        part = spelled(item)
        if part is None or len(strings) * len(part) > MOST_STRINGS:
            close(strings)
            strings = part if part is not None else {""}
        else:
            strings = {a + b for a, b in itertools.product(strings, part)}
    close(strings)
    return clauses


def trigram_index(documents: DataFrame, key: str, text: str, wanted: Sequence[str]) -> DataFrame:
    """Postings: one row (trigram, ``key``) for each wanted trigram that the lower-cased text holds."""
    held = let(F.lower(text_of(text)), lambda low: F.filter(
        F.array(*[F.lit(t) for t in wanted]), lambda t: F.contains(low, t)))
    return documents.select(F.col(key).alias("key"), F.explode(held).alias("trigram"))


def candidates(documents: DataFrame, rules: Sequence[Rule], key: str, text: str) -> tuple[DataFrame, set[str]]:
    """(key, kinds): the rules whose Boolean query a document meets; and the kinds that every document must be read for."""
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    whole = {kind for kind, clauses in queries.items() if not clauses}
    terms = [(kind, c, a, t, len(alternative), len(clauses))
             for kind, clauses in queries.items() for c, clause in enumerate(clauses)
             for a, alternative in enumerate(sorted(clause, key=sorted)) for t in sorted(alternative)]
    spark = documents.sparkSession
    # As many rows as the rules have trigrams, whatever the documents.
    query = F.broadcast(spark.createDataFrame(
        terms, "kind string, clause int, alternative int, trigram string, n_trigrams int, n_clauses int"))
    postings = trigram_index(documents, key, text, sorted({t[3] for t in terms}))
    found = (
        postings.join(query, "trigram")
        .groupBy("key", "kind", "clause", "alternative", "n_trigrams", "n_clauses")
        .agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == F.col("n_trigrams"))
        .groupBy("key", "kind", "n_clauses")
        .agg(F.count_distinct("clause").alias("n")).where(F.col("n") == F.col("n_clauses"))
        .groupBy("key").agg(F.collect_set("kind").alias("kinds")))
    return found, whole


def _matches(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end, kind) of one rule in one text."""

    def long_enough(hit: Column) -> Column:
        value = F.regexp_extract(hit, rule.pattern, rule.group) if rule.group else hit
        return F.char_length(value) >= rule.least

    found = located(text, rule.pattern, long_enough if rule.least > 1 else None)
    return F.transform(found, lambda m: F.struct(
        m["start"], F.lit(number).alias("number"), m["end"], F.lit(rule.kind).alias("kind")))


def scan(documents: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with ``secrets``: an array of (start, number of the rule, end, kind) in order."""
    found, whole = candidates(documents, rules, key, text)
    found = settle(found, "secret-candidates")
    few = found.count() <= BROADCAST_CANDIDATES
    rows = documents.select(F.struct("*").alias("doc"), F.col(key).alias("id"), text_of(text).alias("content"))
    joined = rows.join(F.broadcast(found) if few else found, F.col("id").eqNullSafe(F.col("key")), "left")
    parts = []
    for number, rule in enumerate(rules):
        spans = F.coalesce(_matches(F.col("content"), rule, number),
                           F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>"))
        parts.append(spans if rule.kind in whole else F.when(
            F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)), spans).otherwise(
                F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")))
    carried = [F.col("doc")[c].alias(c) for c in documents.columns if c.lower() != "secrets"]
    return joined.select(*carried, F.array_sort(F.concat(*parts)).alias("secrets"))


def listed(secrets: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(scanned: DataFrame, text: str = "text") -> DataFrame:
    """Texts in which each run of overlapping spans is replaced by the kind of its first span in brackets."""
    masked = replaced(text_of(text), F.col("secrets"), lambda span: F.concat(F.lit("["), span["kind"], F.lit("]")))
    return scanned.withColumn(text, F.when(F.size("secrets") > 0, masked).otherwise(F.col(text))).drop("secrets")


def digests(scanned: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE,
            key: str = "doc_id") -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as text."""
    kinds = [rule.kind for rule in base]
    base_spans = F.filter("secrets", lambda s: s["kind"].isin(kinds))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(key, *map(count, kinds), F.sha2(listed(base_spans), 256).alias("base_sha256"),
                          listed(F.col("secrets")).alias("spans"))
