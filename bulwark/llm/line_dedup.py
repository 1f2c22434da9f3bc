"""Line dedup by distinct-site spread, in DataFrame operations only.

Each distinct line gets a HyperLogLog sketch of the sites (``source``) it occurs on; partial sketches merge in the
aggregation.  Lines whose estimate lies near the threshold are counted exactly.  Lines on ``min_sites`` sites or more
are boilerplate and leave the documents.  Lines seen fewer than ``min_sites`` times in all get no sketch: they cannot
reach the threshold.

A document that consists of such lines alone is a copy as a whole rather than a carrier of boilerplate, and is left as it is;
document-level operators handle copies.  Any other document loses all of them, whatever their share.

Lines are split at ``\\n`` and compared without white space at their ends; blank lines are never removed.  Defined cases:
null texts stay null and have no lines; a null source is a site of its own; repeated rows are cleaned alike; other
columns are carried through untouched, except ``n_chars``, which follows the text; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import checkpointed, let

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 5
#: HyperLogLog with 2^12 registers errs by 1.6 %: six deviations decide what is near the threshold.
LOG_REGISTERS = 12
NEAR = 0.1


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def line_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, th, site, pos, h, n`` of every line that isn't blank; ``doc_id, th`` stand for a text."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.xxhash64(F.coalesce("source", F.lit("\0null"))).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.withColumn("line", stripped(F.col("line"))).filter("line <> ''").select("doc_id", "th", "site", "pos", F.xxhash64("line").alias("h"), F.length("line").alias("n"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``h, n, sites`` of the lines on ``min_sites`` sites or more; ``sites`` is exact near the threshold, else estimated."""
    often = lines.groupBy("h", "n").agg(F.count("*").alias("seen"), F.min("site").alias("lo"), F.max("site").alias("hi"))
    often = often.filter((F.col("seen") >= min_sites) & ((F.col("lo") != F.col("hi")) | F.lit(min_sites <= 1))).select("h", "n")
    often = checkpointed(often)
    at = lines.select("h", "n", "site").distinct().join(often, ["h", "n"], "left_semi")
    sketched = at.groupBy("h", "n").agg(F.hll_sketch_agg("site", LOG_REGISTERS).alias("sketch"))
    sketched = checkpointed(sketched.select("h", "n", F.hll_sketch_estimate("sketch").alias("sites")))
    reach = max(2.0, NEAR * min_sites)
    near = (F.col("sites") >= min_sites - reach) & (F.col("sites") <= min_sites + reach)
    exact = at.join(sketched.filter(near).select("h", "n"), ["h", "n"], "left_semi").groupBy("h", "n").agg(F.count("*").alias("sites"))
    return sketched.filter(~near).unionByName(exact).filter(F.col("sites") >= min_sites)


def without(lines: Column, gone: Column) -> Column:
    """``lines`` less the positions in the sorted array ``gone``, in one pass over both."""

    def runs(rows: Column) -> Column:
        def run(k: Column) -> Column:
            start = F.when(k == 0, F.lit(0)).otherwise(F.get(gone, k - 1) + 1)
            end = F.when(k == F.size(gone), F.size(rows)).otherwise(F.get(gone, k))
            return F.slice(rows, start + 1, end - start)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), run))

    return let(lines, runs)


def flagged(docs: DataFrame, min_sites: int) -> DataFrame:
    """``__doc_id, __of, __gone``: sorted positions of the lines that a document loses."""
    lines = checkpointed(line_rows(docs))
    spread = checkpointed(spread_lines(lines, min_sites).select("h", "n", F.lit(True).alias("out")))
    marked = lines.join(spread, ["h", "n"], "left")
    per = marked.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.when(F.col("out"), F.col("pos")))).alias("gone"), F.max(F.col("out").isNull()).alias("own"))
    return per.filter((F.size("gone") > 0) & F.col("own")).select(F.col("doc_id").alias("__doc_id"), F.col("th").alias("__of"), F.col("gone").alias("__gone"))


def clean_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``."""
    return with_clean(docs, min_sites).select("doc.*")


def with_clean(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``doc``, the cleaned row of ``docs`` as a struct, and ``gone``: the positions of removed lines, null where nothing went."""
    marks = flagged(docs, min_sites)
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    same = (F.col("th") == F.col("__of")) & F.col("id").eqNullSafe(F.col("__doc_id"))
    out = keyed.join(marks, same, "left").select("doc", F.col("__gone").alias("gone"))
    clean = F.array_join(without(F.split("doc.text", "\n", -1), F.col("gone")), "\n")
    changed = F.col("doc").withField("text", clean)
    if "n_chars" in docs.columns:
        changed = let(changed, lambda d: d.withField("n_chars", F.length(d["text"]).cast(docs.schema["n_chars"].dataType)))
    return out.select(F.when(F.col("gone").isNull(), F.col("doc")).otherwise(changed).alias("doc"), "gone")


def line_report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``doc_id, n_removed, n_chars, text_sha256`` of every cleaned document."""
    cleaned = with_clean(docs.select("doc_id", "text", "source"), min_sites)
    text = F.coalesce("doc.text", F.lit(""))
    return cleaned.select("doc.doc_id", F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"), F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


#: DuckDB's SQL for ``line_report`` over the table ``documents``.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(source, chr(1) || 'null') AS site FROM documents),
l AS (SELECT r, site, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
s AS (SELECT *, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l),
b AS (SELECT line FROM s WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
m AS (SELECT s.*, b.line IS NOT NULL AS gone FROM s LEFT JOIN b USING (line)),
t AS (
  SELECT r, count(*) FILTER (gone) AS n_gone, count(*) FILTER (gone) > 0 AND count(*) FILTER (NOT gone AND line <> '') > 0 AS act,
    coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS rest
  FROM m GROUP BY r
),
o AS (SELECT doc_id, CASE WHEN act THEN n_gone ELSE 0 END AS n_removed, CASE WHEN act THEN rest ELSE coalesce(text, '') END AS out FROM d LEFT JOIN t USING (r))
SELECT doc_id, CAST(n_removed AS BIGINT) AS n_removed, CAST(length(out) AS BIGINT) AS n_chars, sha256(out) AS text_sha256 FROM o
"""
