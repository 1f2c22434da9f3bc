"""Trie of conversation prefixes by chained digests.

Each turn becomes a SHA-256 of its role and text, so that no text is ever shuffled.  A conversation's turns, in order,
are chained: the digest of the first d turns is the SHA-256 of the digest of the first d - 1 and of turn d.  Every prefix
is exploded, and prefixes of equal (depth, digest) are one node.  Sums over subtrees come from exploding each node to
all its ancestors and grouping by ancestor.  Two things keep that explosion in proportion to the input:

* nodes of a single conversation are not exploded: they form its tail, which holds one leaf and saves nothing;
* depths are cut in blocks of ``FAN``: a node is exploded to the ancestors of its block, the sums at block tops go
  up block by block in the same manner (blocks of blocks at the next level), and each top's total to the block above.

A conversation is chained by one task that reads it in order and holds one digest; nodes that many conversations share
are counted by partial sums.  Ids of the conversations that end at a node are sorted over the whole cluster, joined in
pieces of ``PIECE``, and the pieces hashed in order by a task that holds one piece at a time.

Defined cases: a null role or text is empty; null turns come first, and turns of equal number in the order of their digests; repeated
rows are turns of their own; rows without ``conv_id`` belong to no conversation and are left out; a negative
``conv_id`` leaves a remainder of its own sign, as in SQL; other columns are not read; an empty table gives no node at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bulwark.llm.common import checkpointed, shuffle_parts

#: A conversation takes at most MOST - 1 turns from the one that opens its group of GROUP.
GROUP, MOST = 5, 9
#: Depths in a block of ancestors.
FAN = 64
#: Ids joined in one piece of text.
PIECE = 4096


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 1)``, turn`` (digest)``, n_bytes`` (of the text) of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), digest.alias("turn"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.withColumn("pos", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_first(), "turn"))).drop("at")


def taken(conv_id: Column) -> Column:
    """Turns that a conversation takes from the opening one of its group."""
    return F.crc32(conv_id.cast("string")) % MOST


def rebuilt(own: DataFrame) -> DataFrame:
    """``conv_id, kind, pos, turn, n_bytes`` of rebuilt conversations, to be read in order of ``kind, pos``; each starts with a row of kind -1."""
    every = own.filter("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), taken(F.col("conv_id")).alias("h"))
    heads = own.filter((F.col("conv_id") % GROUP == 0) & (F.col("pos") < MOST)).withColumnRenamed("conv_id", "base")
    first = every.join(heads, "base").filter(F.col("pos") <= F.col("h")).select("conv_id", F.lit(0).alias("kind"), "pos", "turn", "n_bytes")
    rest = own.filter(F.col("pos") > taken(F.col("conv_id"))).select("conv_id", F.lit(1).alias("kind"), "pos", "turn", "n_bytes")
    roots = every.select("conv_id", F.lit(-1).alias("kind"), F.lit(0).alias("pos"), F.lit(b"").alias("turn"), F.lit(0).cast("long").alias("n_bytes"))
    return first.unionByName(rest).unionByName(roots)


def prefixes(turns_in_order: DataFrame) -> DataFrame:
    """``conv_id, depth, digest, parent, n_bytes, ends`` of every prefix, the empty one included."""

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["conv_id", "depth", "digest", "parent", "n_bytes", "ends"]
        held: list | None = None  # the last prefix, until it is known whether its conversation goes on
        for batch in batches:
            out = []
            for conv_id, kind, turn, n_bytes in zip(batch["conv_id"].tolist(), batch["kind"].tolist(), batch["turn"], batch["n_bytes"].tolist()):
                if kind < 0:
                    nxt = [conv_id, 0, b"", b"", 0, True]
                else:
                    nxt = [conv_id, held[1] + 1, hashlib.sha256(held[2] + bytes(turn)).digest(), held[2], n_bytes, True]
                    held[5] = False
                if held:
                    out.append(held)
                held = nxt
            yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame([held], columns=columns)

    ordered = turns_in_order.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "pos")
    return ordered.select("conv_id", "kind", "turn", "n_bytes").mapInPandas(chain, "conv_id long, depth long, digest binary, parent binary, n_bytes long, ends boolean")


def subtree_sums(values: DataFrame, paths: DataFrame, deepest: int, fan: int = FAN, stride: int = 1) -> DataFrame:
    """``conv_id, depth, digest, leaves, saved`` summed over the subtree of each node in ``values`` (the same columns).

    ``values`` hold nodes at multiples of ``stride``; ``conv_id`` is a member, whose ``paths`` name the ancestors.
    """
    block = stride * fan
    steps = paths.filter(F.col("depth") % stride == 0).select("conv_id", F.floor(F.col("depth") / block).alias("block"), F.col("depth").alias("up"), F.col("digest").alias("of"))
    at = ["conv_id", "up", "of", "leaves", "saved"]
    rows = values.withColumn("block", F.floor(F.col("depth") / block)).join(steps, ["conv_id", "block"]).filter(F.col("up") <= F.col("depth")).select(at)

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("up").alias("depth"), F.col("of").alias("digest")).agg(F.min("conv_id").alias("conv_id"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    if deepest >= block:
        rows = checkpointed(rows)
        tops = checkpointed(subtree_sums(summed(rows.filter(F.col("up") % block == 0)), paths, deepest, fan, block))
        below = tops.filter(F.col("depth") >= block).withColumn("block", F.floor(F.col("depth") / block) - 1).join(steps, ["conv_id", "block"]).select(at)
        rows = rows.unionByName(below)
    return summed(rows)


def end_digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """``depth, digest, ends_sha256``: SHA-256 of the ids of ``ends`` (``depth, digest, conv_id``), ascending and comma-joined."""

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, ids = None, []
        for batch in batches:
            out = []
            for depth, digest, conv_id in zip(batch["depth"].tolist(), batch["digest"], batch["conv_id"].tolist()):
                if ids and (node != (depth, bytes(digest)) or len(ids) >= piece):
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = (depth, bytes(digest))
                ids.append(conv_id)
            yield pd.DataFrame(out, columns=["depth", "digest", "first", "ids"])
        if ids:
            yield pd.DataFrame([(*node, ids[0], ",".join(map(str, ids)))], columns=["depth", "digest", "first", "ids"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, sha = None, None
        for batch in batches:
            out = []
            for depth, digest, ids in zip(batch["depth"].tolist(), batch["digest"], batch["ids"]):
                if node == (depth, bytes(digest)):
                    sha.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = (depth, bytes(digest)), hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["depth", "digest", "ends_sha256"])
        if node:
            yield pd.DataFrame([(*node, sha.hexdigest())], columns=["depth", "digest", "ends_sha256"])

    keys = ["depth", "digest", "conv_id"]
    pieces = ends.repartitionByRange(shuffle_parts(ends.sparkSession), *keys).sortWithinPartitions(*keys).mapInPandas(joined, "depth long, digest binary, first long, ids string")
    return pieces.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "first").select("depth", "digest", "ids").mapInPandas(hashed, "depth long, digest binary, ends_sha256 string")


def trie_of(turns_in_order: DataFrame, fan: int = FAN, piece: int = PIECE) -> DataFrame:
    """The nodes of the trie: ``depth, digest, parent, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns_in_order`` is ``conv_id, kind, pos, turn, n_bytes`` with one row of kind -1 a conversation, as ``rebuilt`` gives it.
    """
    paths = checkpointed(prefixes(turns_in_order))
    nodes = paths.groupBy("depth", "digest", "parent").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes"))
    nodes = checkpointed(nodes)
    single = F.col("n_convs") == 1
    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("children"), F.count_if(single).alias("tails"))
    known = nodes.join(below, ["depth", "digest"], "left").withColumn("n_children", F.coalesce("children", F.lit(0)))
    shared = known.filter(~single).select(
        "conv_id", "depth", "digest", F.when(F.col("n_children") == 0, 1).otherwise(F.col("tails")).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
    )
    shared = checkpointed(shared)
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(shared, paths, deepest, fan).select("depth", "digest", "leaves", "saved")
    ends = end_digests(paths.filter("ends").select("depth", "digest", "conv_id"), piece)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = known.join(sums, ["depth", "digest"], "left").join(ends, ["depth", "digest"], "left").join(parents, ["depth", "parent"], "left")
    return out.select(
        "depth", "digest", "parent", "conv_id", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, fan: int = FAN, piece: int = PIECE) -> DataFrame:
    """The trie of the conversations as they stand."""
    own = turns(conversations)
    roots = own.filter("pos = 1").select("conv_id", F.lit(-1).alias("kind"), F.lit(0).alias("pos"), F.lit(b"").alias("turn"), F.lit(0).cast("long").alias("n_bytes"))
    return trie_of(own.withColumn("kind", F.lit(1)).unionByName(roots), fan, piece)


def rebuilt_trie(conversations: DataFrame, fan: int = FAN, piece: int = PIECE) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of rebuilt conversations."""
    own = checkpointed(turns(conversations))
    return trie_of(rebuilt(own), fan, piece).drop("digest", "parent")


#: DuckDB's SQL for ``rebuilt_trie`` over the table ``conversations``: nodes are compared as whole lists of turns.
SQL = f"""
WITH t AS (
  SELECT conv_id, turn, strlen(coalesce(text, '')) AS b, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
),
l AS (SELECT conv_id, list({{'k': k, 'b': b}} ORDER BY turn NULLS FIRST, k) AS ts FROM t GROUP BY conv_id),
c AS (
  SELECT conv_id, ts, conv_id - conv_id % {GROUP} AS base,
    xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
      lambda r, x: list_reduce(CAST(range(8) AS BIGINT[]), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(r, x)), CAST(4294967295 AS BIGINT)), 4294967295) % {MOST} AS h
  FROM l
),
r AS (SELECT c.conv_id, coalesce(o.ts[1:c.h], []) || coalesce(c.ts[c.h + 1:], []) AS ts FROM c LEFT JOIN l AS o ON o.conv_id = c.base),
p AS (SELECT conv_id, d, ts[1:d] AS k, len(ts) = d AS e, CASE WHEN d = 0 THEN 0 ELSE ts[d].b END AS b FROM (SELECT *, unnest(range(len(ts) + 1)) AS d FROM r)),
n AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, min(b) AS b, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (e), '')) AS ends_sha256
  FROM p GROUP BY d, k
),
f AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN f USING (d, k)),
a AS (SELECT up AS d, k[1:up] AS k, count_if(n_children = 0) AS n_leaves, sum((n_convs - 1) * b) AS saved FROM (SELECT *, unnest(range(d + 1)) AS up FROM m) GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN a ON a.d = m.d AND a.k = m.k LEFT JOIN n AS q ON q.d = m.d - 1 AND q.k = m.k[1:m.d - 1]
"""
