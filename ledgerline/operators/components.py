"""Connected components of an edge table, by repeated contraction.

Each round gives every node its smallest neighbour (or itself) as parent, follows parents to the root, and replaces
both ends of every edge by their roots. A root has a larger neighbour in its tree, so the nodes at least halve each
round. Before the first round every task merges its own edges into stars, which bounded memory allows and which leaves
few rounds. Minima are combined before the shuffle, so a node with very many edges does no harm.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import cut_lineage

# The task function travels with the plan, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A task passes its stars on and starts anew when it holds more than so many nodes.
MOST_NODES = 500_000


class Union:
    """Disjoint sets whose root is the smallest member."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def root(self, node):
        parent = self.parent
        above = parent.setdefault(node, node)
        while above != node:
            parent[node] = parent[above]
            node, above = above, parent[above]
        return node

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    union, schema = Union(), None

    def passed() -> pa.RecordBatch:
        nodes = [node for node in union.parent if union.root(node) != node]
        return pa.RecordBatch.from_arrays([pa.array([union.root(node) for node in nodes], schema[0].type),
                                           pa.array(nodes, schema[1].type)], names=["a", "b"])

    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            union.join(a, b)
        if len(union.parent) > MOST_NODES:
            yield passed()
            union = Union()
    if schema is not None:
        yield passed()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b): the smallest node reachable from it."""
    edges = edges.select("a", "b").where(F.col("a") != F.col("b"))
    # Each task's share of the distinct edges, so that it is not a second Python step of the task that made them.
    edges = cut_lineage(edges.distinct().mapInArrow(_stars, edges.schema).distinct())
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
                         .select("node", F.least("node", "least").alias("parent")))
        while True:
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
            jumped = cut_lineage(parents.join(above, "parent").select(
                "node", F.col("root").alias("parent"), (F.col("root") != F.col("parent")).alias("moved")))
            parents = jumped.select("node", "parent")
            if jumped.where("moved").isEmpty():
                break
        edges = cut_lineage(
            edges.join(parents.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
            .join(parents.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
            .where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        if found is None:
            found = parents.select("node", F.col("parent").alias("component"))
        else:
            onward = parents.select(F.col("node").alias("component"), "parent")
            found = cut_lineage(found.join(onward, "component", "left").select(
                "node", F.coalesce("parent", "component").alias("component")))
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
