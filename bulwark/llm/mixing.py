"""Mixing sources to target weights by systematic sampling.

Sizes are words.  Each source's target is its weight's share of all words, at most ``max_repeat`` times what it has, the
excess going to the others by weight.  A document's expected copies are its source's target over its source's
size; the expected copies are prefix-summed within the source, one random offset is added, and a document is emitted
once for each integer boundary that its interval crosses, so it is never emitted more than ``ceil`` of them times.

Inside a source the documents stand in classes of size (the integer root of their words), so that the systematic sample takes long and
short documents alike: the words it takes miss the target by little more than the longest document, whatever the offset.  No source is
summed in one task.  A class is dealt to buckets by a hash of the id; ranks come from prefix sums of the counts of classes, of groups
of buckets and of buckets, and from the order by size inside a bucket.

All arithmetic that decides a boundary is on integers (a source's expected copies are a fraction in millionths, rounded
down), so reruns agree.  A source of a few documents can miss its target by as much as its longest one.  Defined cases: a null text has size 0; null is a source of its own, after all others; documents of
size 0 never add words; repeated rows are ranked one after another; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bulwark.llm.common import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEAT = 3
SEED = 7
#: Documents that a bucket is meant to hold, and the logarithm of the buckets in a group.
BUCKET = 512
GROUP_BITS = 9
SCALE = 1_000_000


def spread_hash(seed: int, *values: Column) -> Column:
    """A number below 2^32 from a digest that any SQL engine has."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(v.cast("string"), F.lit("")) for v in values])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per source of ``__source, __size, __docs``: ``target`` words, the weights being 1, 2, 3, repeating, by code point.

    A source is capped when filling every source up to its own level of words per weight would still leave
    words to give out; the rest share what the capped leave.  There is one row for each source.
    """
    place = F.row_number().over(W.orderBy(F.col("__source").asc_nulls_last()))
    w = sizes.withColumn("weight", (place - 1) % 3 + 1).withColumn("cap", max_repeat * F.col("__size"))
    w = w.withColumn("level", F.col("cap") / F.col("weight"))
    upto, every = W.orderBy("level").rangeBetween(W.unboundedPreceding, 0), W.partitionBy()
    w = w.withColumn("filled", F.sum("cap").over(upto)).withColumn("above", F.sum("weight").over(every) - F.sum("weight").over(upto)).withColumn("total", F.sum("__size").over(every))
    w = w.withColumn("capped", F.col("filled") + F.col("level") * F.col("above") <= F.col("total"))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    return w.select("__source", "__size", "__docs", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(left * F.col("weight") / open_weight).alias("__target"))


def offset(seed: int, source: Column) -> Column:
    """The one random offset of a source, in millionths."""
    return spread_hash(seed, F.lit("offset"), F.coalesce(source, F.lit("<null>"))) % SCALE


def copies(rows: DataFrame, seed: int = SEED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``rows`` (``id, source, size`` and what they carry) with ``source_size, target`` and ``copies``, how often each is taken."""
    # the words of the texts are counted once, here
    rows = checkpointed(rows.withColumn("class", F.floor(F.sqrt("size")).cast("long")))
    classes = checkpointed(rows.groupBy("source", "class").agg(F.sum("size").alias("size"), F.count("*").alias("docs")))
    totals = classes.groupBy(F.col("source").alias("__source")).agg(F.sum("size").alias("__size"), F.sum("docs").alias("__docs"))
    per = F.coalesce(F.floor(F.least(F.col("__target") / F.when(F.col("__size") > 0, F.col("__size")), F.lit(float(max_repeat))) * SCALE), F.lit(0)).cast("long")
    sources = targets(totals, max_repeat).select(F.col("__source"), F.col("__size").alias("source_size"), F.col("__target").alias("target"), per.alias("per"), offset(seed, F.col("__source")).alias("offset"))
    before = lambda what, by, *part: F.coalesce(F.sum(what).over(W.partitionBy(*part).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    classes = classes.withColumn("lead", before("docs", "class", "source")).join(sources, F.col("source").eqNullSafe(F.col("__source")))
    classes = checkpointed(classes.select(F.col("source").alias("c_source"), F.col("class").alias("c_class"), "lead", F.ceil(F.col("docs") / BUCKET).cast("long").alias("buckets"), "source_size", "target", "per", "offset"))
    rows = rows.join(classes, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("class") == F.col("c_class"))).drop("c_source", "c_class")
    rows = rows.withColumn("bucket", F.shiftright(spread_hash(seed, F.col("id")) * F.col("buckets"), 32))

    part = ["source", "class"]
    bucket = rows.groupBy(*part, "bucket").agg(F.count("*").alias("docs")).withColumn("group", F.shiftright("bucket", GROUP_BITS))
    group = bucket.groupBy(*part, "group").agg(F.sum("docs").alias("docs"))
    group = group.select(F.col("source").alias("g_source"), F.col("class").alias("g_class"), F.col("group").alias("g"), before("docs", "group", *part).alias("in_class"))
    bucket = bucket.withColumn("in_group", before("docs", "bucket", *part, "group"))
    bucket = bucket.join(group, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("class") == F.col("g_class")) & (F.col("group") == F.col("g")))
    bucket = checkpointed(bucket.select(F.col("source").alias("b_source"), F.col("class").alias("b_class"), F.col("bucket").alias("b"), (F.col("in_class") + F.col("in_group")).alias("ahead")))

    rows = rows.withColumn("at", F.row_number().over(W.partitionBy(*part, "bucket").orderBy("size", F.col("id").asc_nulls_last())))
    rows = rows.join(bucket, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("class") == F.col("b_class")) & (F.col("bucket") == F.col("b")))
    crossed = F.expr(f"({RANK} * per + offset) div {SCALE} - (({RANK} - 1) * per + offset) div {SCALE}")
    return rows.withColumn("copies", crossed).drop("class", "lead", "buckets", "per", "offset", "bucket", "at", "ahead", "b_source", "b_class", "b")


#: SQL of a document's place in its source, from 1: integer boundaries between its end and the one before are its copies.
RANK = "(lead + ahead + at)"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document, taken or not."""
    mixed = copies(docs.select(F.col("doc_id").alias("id"), "source", words(F.col("text")).alias("size")), seed)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def hashable(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``; those with maps, which have no hash, as JSON."""
    return [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    The copies are worked out without the texts; the taken rows, known by two hashes of all their columns, are then
    picked.
    """
    key = ["row", "row2"]
    every = hashable(docs)
    keyed = docs.select(F.struct("*").alias("doc"), F.xxhash64(*every).alias("row"), F.hash(*every).alias("row2"))
    taken = copies(keyed.select(F.col("doc.doc_id").alias("id"), "doc.source", words(F.col("doc.text")).alias("size"), *key), seed)
    taken = checkpointed(taken.groupBy(*key).agg(F.sum("copies").alias("take"), F.count("*").alias("rows")).filter("take > 0"))
    out = keyed.join(taken.filter("rows = 1"), key)
    repeated = taken.filter("rows > 1")
    if not repeated.isEmpty():
        out = out.unionByName(keyed.join(repeated, key).dropDuplicates(key).select(*out.columns))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("take").cast("int")))).select("doc.*")


#: DuckDB's SQL for ``mix_report`` over the table ``documents``: the same hashes, ranks and boundaries.
SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, count(*) AS docs, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w FROM d GROUP BY source),
s1 AS (SELECT *, {MAX_REPEAT} * s AS cap, CAST({MAX_REPEAT} * s AS DOUBLE) / w AS level FROM s0),
s2 AS (SELECT *, sum(cap) OVER u + level * (sum(w) OVER () - sum(w) OVER u) <= sum(s) OVER () AS capped, sum(s) OVER () AS total
  FROM s1 WINDOW u AS (ORDER BY level RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s3 AS (SELECT source, s, docs, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
    CAST(CAST(total - coalesce(sum(cap) FILTER (capped) OVER (), 0) AS BIGINT) * w AS DOUBLE) / CAST(sum(w) FILTER (NOT capped) OVER () AS DOUBLE) END AS target FROM s2),
s4 AS (SELECT *, coalesce(CAST(floor(least(target / nullif(s, 0), {float(MAX_REPEAT)}) * {SCALE}) AS BIGINT), 0) AS per,
    CAST('0x' || substr(md5('{SEED}:offset:' || coalesce(source, '<null>')), 1, 8) AS BIGINT) % {SCALE} AS off FROM s3),
n AS (SELECT *, CAST(floor(sqrt(size)) AS BIGINT) AS class FROM d),
c AS (SELECT *, CAST(ceil(count(*) OVER (PARTITION BY source, class) / {BUCKET}) AS BIGINT) AS buckets FROM n),
r AS (SELECT c.*, s4.s, s4.target, s4.per, s4.off, (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) * buckets) >> 32 AS bucket
  FROM c JOIN s4 ON c.source IS NOT DISTINCT FROM s4.source),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, bucket, size, doc_id NULLS LAST) AS rank FROM r)
SELECT doc_id, size, s AS source_size, target, size * ((rank * per + off) // {SCALE} - ((rank - 1) * per + off) // {SCALE}) AS taken FROM k
"""
