"""URL filters (8): host and path rules, then redirect equivalence.

Rules are matched per distinct host: the suffixes of a host are joined with the rules' hosts, so the rule table can be
as large as a block list and a host with a third of all pages is matched once. A page takes the longest of its host's
rules whose path its own path starts with.

Pages without a rule take the verdict of their aliases: canonical links and refresh redirects in the pages (and any
further redirects handed in) are edges between addresses, whose connected components are found with SQL joins. A
component with a blocked address blocks its members, unless one of its addresses is explicitly allowed.

Links are read from the tags of a page, not from its comments, scripts and styles, and resolved as a browser does: against
the page's base address if it names one, with ``.`` and ``..`` taken out of paths. As an alias an address with an empty
path is that of ``/``; rules see the path as it is written. Targets that are no web addresses (``mailto:``) are no links.

Defined results: null addresses, and those without ``://``, have an empty host and path and no rule; repeated rows are
judged each; an empty table gives an empty table; pages that nothing blocks are allowed.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.storage import settle
from ledgerline.operators.components import components

#: A table of hosts or aliases of up to so many rows (some 100 bytes each) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000

Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _settled(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments; an empty one is ``/``."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda found, part: (
        F.when(part == ".", found)
        .when(part == "..", F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))))
        .otherwise(F.concat(found, F.array(part)))))
    folder = F.element_at(parts, -1).isin(".", "..")
    rebuilt = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder & (F.size(kept) > 0), "/").otherwise(""))
    return F.when(path == "", "/").when(path.rlike(r"/\.{1,2}(/|\z)"), rebuilt).otherwise(path)


def address_of(url: Column) -> Column:
    """Host, path and query: what is left of an address without its scheme and fragment; null without ``://``."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), _settled(path_of(url)), query))


def _small(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): all rules of each host of ``hosts`` that has any, as an array of (size, allows, path, rule)."""
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels) - i + 1), "."))
    named = rules.select(F.col("host").alias("suffix"), F.struct(
        (F.char_length("host") + F.char_length("path")).alias("size"), (F.col("verdict") == "allow").alias("allows"),
        "path", F.concat("host", "path").alias("rule")).alias("rule"))
    return (hosts.select("host").where("host != ''").distinct()
            .select("host", F.explode(suffixes).alias("suffix")).join(named, "suffix")
            .groupBy("host").agg(F.collect_set("rule").alias("rules")))


def ruled(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule`` and ``ruled`` (its verdict) to rows with ``host`` and ``path``: the longest rule that fits."""
    by_host = settle(host_rules(rows, rules), "host-rules").withColumnRenamed("host", "of_host")
    fitting = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    return (rows.join(_small(by_host), F.col("host") == F.col("of_host"), "left")
            .withColumn("best", F.array_max(fitting))
            .withColumns({"rule": F.col("best.rule"), "ruled": F.when(F.col("best.allows"), "allow").when(
                ~F.col("best.allows"), "block")})
            .drop("rules", "of_host", "best"))


#: What holds no links: comments, and elements whose text is no markup.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title)\b.*?(?:</\1\s*>|\z)"
SCHEME = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:"


def _absolute(target: Column, url: Column) -> Column:
    """``target`` as a full address, as seen from the page at ``url``; null if it is no web address."""
    folder = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*/)", 1)
    here = F.concat(F.lit("http://"), host_of(url))
    return (F.when(target.rlike(SCHEME + "//"), target)
            .when(target.rlike(SCHEME), F.lit(None).cast("string"))
            .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
            .when(F.startswith(target, F.lit("/")), F.concat(here, target))
            .when(target.rlike("^[?#]"), F.concat(here, path_of(url), target))
            .otherwise(F.concat(here, F.when(folder == "", "/").otherwise(folder), target)))


def _attribute(tag: Column, pattern: str) -> Column:
    return F.regexp_replace(F.regexp_extract(tag, pattern, 1), "(?i)&amp;", "&")


HREF = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): addresses of pages and of what they name as canonical address or redirect to at once."""
    tags = F.regexp_extract_all(F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), UNREAD, " "),
                                F.lit(r"(?is)<(?:link|meta|base)\b[^>]*>"), F.lit(0))
    base = F.get(F.filter("tags", lambda tag: tag.rlike("(?i)^<base") & tag.rlike(HREF)), 0)
    links = F.filter("tags", lambda tag: (
        tag.rlike("(?i)^<link") & tag.rlike(r"""(?i)\brel\s*=\s*["']?canonical\b""")
        | tag.rlike("(?i)^<meta") & tag.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b""")))
    target = F.when(F.col("tag").rlike("(?i)^<link"), _attribute(F.col("tag"), HREF)).otherwise(
        _attribute(F.col("tag"), r"""(?is)\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'\s>]+)"""))
    page, lower = F.col("url"), F.lower("html")
    # Pages without either word have no such tag. The generator keeps the tags from being worked out once per use.
    return (pages.where(F.contains(page, F.lit("://")))
            .where(F.contains(lower, F.lit("canonical")) | F.contains(lower, F.lit("refresh")))
            .select("url", F.explode(F.array(tags)).alias("tags"))
            .select("url", F.coalesce(_absolute(_attribute(base, HREF), page), page).alias("base"),
                    F.explode(links).alias("tag"))
            .select("url", "base", target.alias("target")).where("target != ''")
            .select(address_of(page).alias("a"), address_of(_absolute(F.col("target"), F.col("base"))).alias("b"))
            .where("a != b").distinct())


def blocked_aliases(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Addresses of components that hold a blocked address and none that is explicitly allowed."""
    members = components(edges)
    url = F.concat(F.lit("http://"), F.col("node"))
    judged = ruled(members.select("node", "component", host_of(url).alias("host"), path_of(url).alias("path")), rules)
    bad = (judged.groupBy("component")
           .agg(F.max((F.col("ruled") == "block").cast("int")).alias("blocks"),
                F.max((F.col("ruled") == "allow").cast("int")).alias("allows"))
           .where("blocks = 1 AND coalesce(allows, 0) = 0").select("component"))
    return members.join(bad, "component", "left_semi").select("node")


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule (or null) and verdict of every page; ``redirects`` has addresses (a, b)."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(*[address_of(F.col(c)).alias(c) for c in ("a", "b")])).where("a != b")
    blocked = settle(blocked_aliases(edges, rules), "blocked-aliases")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                        address_of(F.col("url")).alias("address"))
    return (ruled(rows, rules)
            .join(_small(blocked.withColumn("alias", F.lit(True))), F.col("address") == F.col("node"), "left")
            .select("page_id", "host", "path", "rule", F.coalesce(
                "ruled", F.when(F.col("alias"), F.lit("block")), F.lit("allow")).alias("verdict")))
