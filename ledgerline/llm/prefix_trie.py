"""Conversation prefix trie (12): ROLLUP over positional columns of turn ids.

Every turn gets an id (a digest of role and text, and the text's bytes). A conversation becomes one row with its first
``BLOCK`` turn ids in columns of their own, and a further row for each next ``BLOCK`` turns. One statement,
``GROUP BY block, prior, ROLLUP (t1, ..., t8)``, aggregates the prefixes of all depths together; ``grouping_id`` tells
their depth. Rows of a further block are keyed by ``prior``, the node at which the block before them ended. That node is
named by its path: the sum of digests of (block number, block content) over all blocks before. A running sum gives it
for all blocks at once, so the number of jobs does not follow the longest conversation.

A node is named by (smallest member, depth). A conversation owns the nodes it is the smallest member of, which are the
last stretch of its path (its chain), so the trie falls into one chain for each owner. Sums over a subtree then need no
climbing: every member brings the sum over its whole chain to the ROLLUP once more, and from what a node gathers, the
part of its owner's chain above the node is taken off by a running sum. Each conversation looks up one other node by
its path: the parent of its chain's top, or, if it owns nothing, the node it ends at.

Hot groups: prefixes shared by many are aggregated before they are shuffled; a conversation with very many turns is
dealt out by ranges of its turns (running sums) and by segments of ``SEGMENT`` rows (joins). Only the digest of a
node's ends reads them one after the other, which a SHA-256 asks for; they are sorted and streamed, never collected.

Defined results: null role or text is empty; rows of one turn number are ordered by role, then by the digest of their
text, and repeated rows stay; a null ``conv_id`` names no conversation, so such rows belong to none; texts of any length
count whole; an empty table gives no nodes; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.columns import text_of
from ledgerline.llm.storage import settle
from ledgerline.operators.ordered_fold import HOT_ROWS
from ledgerline.operators.running import running_stats

#: Positional columns of a row.
BLOCK = 8
#: Rows of one conversation that meet in a join.
SEGMENT = 4096

_SLOTS = [f"t{j}" for j in range(1, BLOCK + 1)]
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def turn_id() -> Column:
    """32 digits of a digest of (role, text), a colon, and the bytes of the text."""
    role, text = text_of("role"), text_of("text")
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.substring(digest, 1, 32), F.lit(":"), F.octet_length(text).cast("string"))


def numbered(conversations: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(conv_id, pos, turn_id): the turns of each conversation, from 1."""
    turns = settle(conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", text_of("role").alias("role"), turn_id().alias("turn_id"),
        F.monotonically_increasing_id().alias("row")), "turns")
    placed = running_stats(turns, key=["conv_id"], order=["turn", "role", "turn_id", "row"],
                           measures={"pos": ("count", "row")}, hot_rows=hot_rows)
    return settle(placed.select("conv_id", "pos", "turn_id"), "numbered")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths (conv_id, depth, turn_id, length) and members (conv_id, length) of conversations as they came."""
    members = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
    paths = _with_member(turns.withColumnRenamed("pos", "depth"), members, F.col("depth"), F.col("length"))
    return paths.select("conv_id", "depth", "turn_id", "length"), members


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths and members after each conversation's first ``h`` turns have been replaced by those of another one."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    members = (
        sizes.withColumns({
            "h": F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(9)),
            "base": F.col("conv_id") - F.col("conv_id") % 5})
        .join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
        .withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
        .withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    members = settle(members.select("conv_id", "base", "n", "h", "m", "length"), "members")
    own = _with_member(turns, members, F.col("pos"), F.col("n")).where("pos > h").select(
        "conv_id", F.expr("pos - h + m").alias("depth"), "turn_id", "length")
    # At most eight turns of one conversation for at most five others.
    first = turns.where(F.col("pos") <= 8).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "turn_id")
    heads = members.join(first, "base").where("depth <= m").select("conv_id", "depth", "turn_id", "length")
    return own.unionByName(heads), members.select("conv_id", "length")


def _with_member(rows: DataFrame, members: DataFrame, place: Column, size: Column) -> DataFrame:
    """``rows`` with what ``members`` knows of their conversation; a long one meets it in segments of its rows."""
    last = F.floor(size / SEGMENT)
    spread = members.withColumn("_segment", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return rows.withColumn("_segment", F.floor(place / SEGMENT)).join(spread, ["conv_id", "_segment"]).drop("_segment")


def blocks(paths: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(conv_id, length, block, prior, t1, ..., t8): a conversation's turns, ``BLOCK`` a row."""
    slot = (F.col("depth") - 1) % BLOCK
    rows = (paths.withColumn("block", F.expr(f"(depth - 1) div {BLOCK}"))
            .groupBy("conv_id", "block")
            .agg(F.max("length").alias("length"),
                 *[F.max(F.when(slot == j, F.col("turn_id"))).alias(name) for j, name in enumerate(_SLOTS)]))
    rows = settle(rows, "blocks")
    digest = F.sha2(F.concat_ws("/", F.col("block").cast("string"), *_SLOTS), 256)
    lanes = {f"lane{k}": F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)") for k in range(2)}
    more = running_stats(
        rows.where(F.col("length") > BLOCK).withColumns(lanes), key=["conv_id"], order=["block"],
        measures={f"upto{k}": ("sum", f"lane{k}") for k in range(2)}, hot_rows=hot_rows)
    prior = F.concat_ws("/", *[(F.col(f"upto{k}") - F.col(f"lane{k}")).cast("string") for k in range(2)])
    more = more.withColumn("prior", prior).select("conv_id", "length", "block", "prior", *_SLOTS)
    return rows.where(F.col("length") <= BLOCK).withColumn("prior", F.lit("0/0")).select(*more.columns).unionByName(more)


def rolled(rows: DataFrame, measures: str = "") -> DataFrame:
    """All prefixes of one turn or more: their place, smallest member (conv_id), members and longest member."""
    slots = ", ".join(_SLOTS)
    grouped = rows.sparkSession.sql(
        f"SELECT block, prior, {slots}, {BLOCK} - bit_count(grouping_id()) AS inside, min(conv_id) AS conv_id, "
        f"count(*) AS n_convs, max(length) AS longest {measures} FROM {{rows}} GROUP BY block, prior, ROLLUP ({slots})",
        rows=rows)
    # A conversation that ends inside its block leaves empty columns, which are no turns.
    last = F.when(F.col("inside") > 0, F.get(F.array(*_SLOTS), F.col("inside") - 1))
    return (grouped.withColumn("last", last).where(F.col("last").isNotNull())
            .withColumn("depth", F.col("block") * BLOCK + F.col("inside"))
            .withColumn("weight", (F.col("n_convs") - 1) * F.substring_index("last", ":", -1).cast("long")))


def _path(upto: Column) -> Column:
    """A name of the prefix that takes the first ``upto`` columns of a row."""
    return F.sha2(F.concat_ws("/", F.col("block").cast("string"), "prior", F.slice(F.array(*_SLOTS), 1, upto)), 256)


def trie(paths: DataFrame, members: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Nodes (``NODE``) and their ends (conv_id, depth, member): the conversations that end at a node."""
    rows = settle(blocks(paths, hot_rows), "keyed-blocks")
    plain = settle(rolled(rows).select(
        _path(F.col("inside").cast("int")).alias("path"), "conv_id", "depth", "weight",
        (F.col("longest") == F.col("depth")).cast("long").alias("leaf")), "prefixes")
    chains = plain.groupBy("conv_id").agg(
        F.min("depth").alias("top"), F.sum("weight").alias("chain_saved"), F.sum("leaf").alias("chain_leaves"))
    chains = settle(members.join(chains, "conv_id", "left").select(
        "conv_id", "length", "top", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chain_saved", "chain_leaves")]), "chains")

    # What members own is gathered by all prefixes they start with.
    known = chains.select("conv_id", "top", "chain_saved", "chain_leaves", F.expr(f"(length - 1) div {BLOCK}").alias("last"))
    wide = _with_member(rows, known, F.col("block"), F.greatest(F.col("last"), F.lit(0)))
    gathered = settle(
        rolled(wide, ", sum(chain_saved) AS members_saved, sum(chain_leaves) AS n_leaves")
        .select("conv_id", "depth", "n_convs", "weight", "members_saved", "n_leaves"), "gathered")
    nodes = running_stats(gathered, key=["conv_id"], order=["depth"], measures={"upto": ("sum", "weight")},
                          hot_rows=hot_rows)
    nodes = nodes.withColumn("saved_tokens", F.expr("members_saved - (upto - weight)"))

    # One row: the node without turns.
    root = chains.agg(
        F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
        F.greatest(F.sum("chain_leaves"), F.lit(1)).alias("n_leaves"), F.sum("chain_saved").alias("saved_tokens"),
    ).where(F.col("conv_id").isNotNull())
    first = F.broadcast(root.select(F.col("conv_id").alias("root_id")))

    # The other node that a conversation must know: above its chain, or where it ends.
    asked = wide.withColumn("at", F.coalesce(F.col("top") - 1, F.col("length"))).where(
        (F.col("at") > 0) & (F.col("block") == F.expr(f"(at - 1) div {BLOCK}")))
    asked = asked.select(F.col("conv_id").alias("asker"), "at", F.col("top").isNotNull().alias("owns"),
                         _path(((F.col("at") - 1) % BLOCK + 1).cast("int")).alias("path"))
    answered = asked.join(plain.select("path", "conv_id"), "path").select("asker", "at", "owns", "conv_id")
    at_root = chains.withColumn("at", F.coalesce(F.col("top") - 1, F.col("length"))).where("at = 0").crossJoin(first).select(
        F.col("conv_id").alias("asker"), "at", F.col("top").isNotNull().alias("owns"), F.col("root_id").alias("conv_id"))
    answered = settle(answered.unionByName(at_root), "answered")

    above = answered.where("owns").select(
        F.col("conv_id").alias("parent_id"), F.col("asker").alias("conv_id"), (F.col("at") + 1).alias("depth"))
    # A node's children: the next one of its owner's chain, and the tops of other chains.
    below = answered.where("owns AND conv_id != asker").groupBy("conv_id", F.col("at").alias("depth")).agg(
        F.count(F.lit(1)).alias("other_children"))
    chain_ends = chains.select("conv_id", F.col("length").alias("longest"))
    shape = nodes.select("conv_id", "depth", "n_convs", "n_leaves", "saved_tokens").unionByName(
        root.select("conv_id", "depth", "n_convs", "n_leaves", "saved_tokens"))
    shape = (
        _with_member(shape, chain_ends, F.col("depth"), F.col("longest"))
        .join(above, ["conv_id", "depth"], "left").join(below, ["conv_id", "depth"], "left")
        .withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("parent_id", "conv_id")))
        .withColumn("n_children", F.coalesce("other_children", F.lit(0)) + (F.col("longest") > F.col("depth")).cast("long")))
    ends = answered.where("NOT owns").select("conv_id", F.col("at").alias("depth"), F.col("asker").alias("member"))
    ends = ends.unionByName(chains.where(F.col("top").isNotNull()).select(
        "conv_id", F.col("length").alias("depth"), F.col("conv_id").alias("member")))
    return shape.select(*NODE), ends


def scan(conversations: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """The trie of whole conversations: nodes and their ends."""
    return trie(*as_they_are(numbered(conversations, hot_rows)), hot_rows)


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): ids of the members that end at a node, in order, joined by commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * 3
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))],
                names=["conv_id", "depth", "ends_sha256"])

        for batch in batches:
            rows = []
            for conv, depth, member in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (conv, depth) == node:
                    digest.update(b",%d" % member)
                    continue
                if node is not None:
                    rows.append((*node, digest.hexdigest()))
                node, digest = (conv, depth), hashlib.sha256(b"%d" % member)
            yield out(rows)
        if node is not None:
            yield out([(*node, digest.hexdigest())])

    return (ends.select(*[F.col(c).cast("long") for c in ("conv_id", "depth", "member")])
            .repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "member")
            .mapInArrow(run, "conv_id bigint, depth bigint, ends_sha256 string"))


def digests(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes with the digest of the members that end there."""
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(end_digests(ends), ["conv_id", "depth"], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
