"""Connected components of an edge table, by joining forests of its partitions.

Every partition first reduces its own edges to a forest of stars (each node under the smallest node that the partition's edges
reach), in memory bounded by the partition.  A node that has several parents, from different partitions, hangs its other
parents under its smallest one; a node whose parent has a parent moves up to it.  Rounds of both, with the partitions' forests in
between, end once every node has one parent and no parent has one.  A node has at most as many parents as there are
partitions, and a parent of many nodes is met in a join of two plain shuffles, which Spark splits.  Rounds are written to the checkpoint
folder, in no more files than the edges' forests had partitions: where Hadoop has no native library, an executor starts
processes for every file (``chmod``), which count with part of its memory until they run their command.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import checkpointed, release

#: Edges that a partition's forest is meant to take in.
PARTITION_EDGES = 1_000_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``node, parent`` of one partition's edges ``u, v``: the parent is the smallest node reached, and smaller than the node."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while x != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    out = [(x, find(x)) for x in [*root]]
    yield pd.DataFrame([(x, r) for x, r in out if x != r], columns=["node", "parent"], dtype="int64")


def forest(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").mapInPandas(_forest, "node long, parent long")


def components(edges: DataFrame, partition_edges: int = PARTITION_EDGES, written: bool = False) -> DataFrame:
    """``node, root`` for every node of the undirected ``edges`` (``u, v``); the root is a component's smallest node.

    An edge from a node to itself and repeated edges are harmless.  The longest path that is left shrinks by half a round at least.
    Edges that are ``written`` (checkpoints, or a union of such) are read twice as they are, others are written first.
    """
    spark = edges.sparkSession
    edges = edges.select("u", "v").filter("u <> v")
    if not written:
        edges = checkpointed(edges)
    parts = edges.rdd.getNumPartitions()
    few = max(1, -(-edges.count() // partition_edges))
    pairs = forest(edges.coalesce(few) if few < parts else edges)
    while True:
        under = pairs.groupBy("node").agg(F.min("parent").alias("parent"), F.collect_set("parent").alias("parents"))
        under = checkpointed(under.coalesce(few))
        above = under.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        up = under.join(above, "parent", "left")
        left = up.agg(F.count_if(F.col("top").isNotNull() | (F.size("parents") > 1))).first()[0]
        if not left:
            break
        moved = up.select(F.col("node").alias("u"), F.coalesce("top", "parent").alias("v"))
        others = under.filter(F.size("parents") > 1).select(F.explode("parents").alias("u"), F.col("parent").alias("v")).filter("u <> v")
        pairs = forest(moved.unionByName(others))
        release(spark)
    return under.select("node", F.col("parent").alias("root")).unionByName(under.select(F.col("parent").alias("node"), F.col("parent").alias("root")).distinct())
