"""Exact dedup by deterministic block naming, in DataFrame operations only.

The normalised text (every character of ``[\\x20\\x09-\\x0D]`` deleted) is cut into blocks of fixed size.
Distinct blocks are sorted by a hash and then by their characters, and numbered in that order; then adjacent numbers are paired
and the distinct pairs sorted and numbered in turn, until one number is left for each document.  Equal numbers mean
equal texts, as blocks whose hashes agree still differ in their characters.  Ranges are cut by the hash, so that the sample
Spark takes to the driver holds eight bytes a block.

Only texts that agree in length and a 64-bit hash with another can be equal, so the others skip the naming; that
test loses nothing.  Names are numbered within range partitions and written to the checkpoint folder, so a lost
executor cannot renumber them.

Defined cases: null counts as empty; rows repeated with one doc_id count as rows of the group, and one of them
stays; among equal lengths a null doc_id stays only if no other row does; columns besides doc_id and text are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import checkpointed, shuffle_parts

#: Code points in a block.
BLOCK = 4096
KEY = ["doc_id", "n", "h"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def numbered(distinct: DataFrame, by: list[str], parts: int) -> DataFrame:
    """Rows in the order of a hash of ``by`` and then ``by``, each with an integer ``name`` that grows with it; written, so that names stay."""
    ordered = distinct.withColumn("order", F.xxhash64(*by)).repartitionByRange(parts, "order").sortWithinPartitions("order", *by)
    return checkpointed(ordered.drop("order").withColumn("name", F.monotonically_increasing_id()))


def on_key(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on ``KEY``, where a null doc_id equals a null doc_id."""
    other = right.select(*[F.col(c).alias(f"r_{c}") if c in KEY else c for c in right.columns])
    same = F.col("n") == F.col("r_n")
    same = same & (F.col("h") == F.col("r_h")) & F.col("doc_id").eqNullSafe(F.col("r_doc_id"))
    return left.join(other, same, how).drop(*[f"r_{c}" for c in KEY])


def identities(texts: DataFrame, parts: int, block: int = BLOCK) -> DataFrame:
    """``KEY`` and the collision-free ``name`` of texts given as ``KEY, norm``."""
    count = F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("i"), F.substring(F.col("norm"), i * block + 1, F.lit(block)).alias("block")))
    blocks = checkpointed(texts.select(*KEY, F.explode(starts).alias("b")).select(*KEY, "b.i", "b.block"))
    most = (blocks.agg(F.max("i")).first()[0] or 0) + 1
    names = numbered(blocks.select("block").distinct(), ["block"], parts)
    named = blocks.join(names, "block").select(*KEY, "i", "name")
    first = True
    while most > 1 or first:
        first = False
        side = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("name")))
        pairs = named.groupBy(*KEY, F.shiftright("i", 1).alias("j")).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"))
        pairs = checkpointed(pairs)
        names = numbered(pairs.select("a", "b").distinct(), ["a", "b"], parts)
        named = pairs.join(names, ["a", "b"]).select(*KEY, F.col("j").alias("i"), "name")
        most = (most + 1) // 2
    return named.select(*KEY, "name")


def exact_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    parts = shuffle_parts(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.length("text").alias("chars"), normalised(F.col("text")).alias("norm"))
    keyed = texts.select("doc_id", "chars", F.length("norm").alias("n"), F.xxhash64("norm").alias("h"), "norm")
    rows = keyed.select("doc_id", "chars", "n", "h", F.sha2("norm", 256).alias("sha")).groupBy("doc_id", "chars", "n", "h", "sha").agg(F.count("*").alias("copies"))
    rows = checkpointed(rows)

    shared = checkpointed(rows.groupBy("n", "h").agg(F.sum("copies").alias("copies")).filter("copies > 1").select("n", "h"))
    candidates = keyed.join(shared, ["n", "h"], "left_semi")
    named = identities(candidates.select(*KEY, "norm"), parts, block)

    alone = -1 - F.pmod(F.xxhash64("doc_id", "h"), F.lit(1 << 40))
    rows = checkpointed(on_key(rows, named, "left").withColumn("group", F.coalesce("name", alone)))
    order = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"))
    # written first: a group of very many rows then meets its line in a join that Spark splits
    groups = checkpointed(rows.filter("name is not null").groupBy("group").agg(F.min(order).alias("best"), F.sum("copies").alias("size")))
    out = rows.join(groups, "group", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    mine = F.col("best").isNull() | ((F.col("best.c") == -F.col("chars")) & F.col("best.d").eqNullSafe(F.col("doc_id")))
    return out.select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.d")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (mine & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


#: DuckDB's SQL for ``exact_groups`` over the table ``documents``.
SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, chars, norm, count(*) OVER (PARTITION BY norm) AS group_size,
    first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k
  FROM t WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id ASC NULLS LAST)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
