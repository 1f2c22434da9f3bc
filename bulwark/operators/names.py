"""Names that lie within two edits of known ones, found by an index instead of by comparing all with all.

Two strings at most d edits apart have a string in common among those that deleting up to d characters makes of each.  So short
names are joined on what is left of them.  Long ones would leave too many strings: they are joined on segments instead.  A known
name is cut into d + 1 segments, one of which an edited copy must still hold within d places of where it was.
Candidates are verified by their distance.  Both joins are plain equi-joins over distinct names, whatever how often names repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.functions.result import let

#: Names longer than this are joined on segments.
LONG = 24


def deletions(name: Column, edits: int) -> Column:
    """The name, and all that is left of it without up to ``edits`` (at most two) of its characters."""

    def without_one(s: Column) -> Column:
        n = F.length(s)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, n)))).otherwise(F.array().cast("array<string>"))

    out = F.array(name)
    if edits >= 1:
        ones = F.array_distinct(without_one(name))
        out = let(ones, lambda o: F.concat(F.array(name), o, F.flatten(F.transform(o, without_one)) if edits == 2 else F.array().cast("array<string>")))
    return F.array_distinct(out)


def _bounds(n: Column, edits: int, k: int) -> tuple[Column, Column]:
    """Where segment ``k`` of a name of ``n`` characters begins (from 0), and its length."""
    begin, end = F.floor(n * k / (edits + 1)), F.floor(n * (k + 1) / (edits + 1))
    return begin.cast("int"), (end - begin).cast("int")


def _segments(name: Column, edits: int) -> Column:
    """``n, k, piece`` of a known name's segments."""
    n = F.length(name)
    each = []
    for k in range(edits + 1):
        begin, size = _bounds(n, edits, k)
        each.append(F.struct(n.alias("n"), F.lit(k).alias("k"), F.substring(name, begin + 1, size).alias("piece")))
    return F.array(*each)


def _probes(name: Column, edits: int) -> Column:
    """``n, k, piece`` of every segment that a known name near this one could have: of its length, at its place, give or take the edits."""
    each = []
    for change in range(-edits, edits + 1):
        n = F.length(name) + change
        for k in range(edits + 1):
            begin, size = _bounds(n, edits, k)
            for shift in range(-edits, edits + 1):
                at = begin + shift
                # a place outside the name gives no piece of the segment's size, and matches nothing
                each.append(F.when(at >= 0, F.struct(n.alias("n"), F.lit(k).alias("k"), F.substring(name, at + 1, size).alias("piece"))))
    return F.array_distinct(F.filter(F.array(*each), lambda p: p.isNotNull()))


def near_names(names: DataFrame, known: DataFrame, edits: int = 2) -> DataFrame:
    """``name, known, distance`` of all distinct names between one and ``edits`` edits from a known one.

    ``names`` has ``name`` and ``known`` has ``known``; names are compared in lower case.  Nulls are near nothing; the
    empty name is a name; repeated names count once; no names give no rows.
    """
    if edits not in (1, 2):
        raise ValueError("one edit or two")
    left = names.filter(F.col("name").isNotNull()).select(F.lower("name").alias("name")).distinct()
    right = known.filter(F.col("known").isNotNull()).select(F.lower("known").alias("known")).distinct()
    short = lambda c: F.length(c) <= LONG
    a = left.filter(short("name")).select("name", F.explode(deletions(F.col("name"), edits)).alias("rest"))
    b = right.filter(short("known")).select("known", F.explode(deletions(F.col("known"), edits)).alias("rest"))
    pairs = a.join(b, "rest").select("name", "known")
    # pairs of which one is long: the other has at most ``edits`` characters less
    c = left.filter(F.length("name") > LONG - edits).select("name", F.inline(_probes(F.col("name"), edits)))
    d = right.filter(F.length("known") > LONG - edits).select("known", F.inline(_segments(F.col("known"), edits)))
    far = c.join(d, ["n", "k", "piece"]).select("name", "known").filter(~(short("name") & short("known")))
    # a name and a known one may meet in many places; most of those that do are no closer than twice the edits
    near = pairs.unionByName(far).withColumn("distance", F.levenshtein("name", "known", edits)).filter(F.col("distance").between(1, edits))
    return near.distinct()


def typosquats(tools: DataFrame, known: DataFrame) -> DataFrame:
    """``tools`` (``name``) that nearly bear the name of a ``known`` one: ``known, distance, severity``, high at one edit."""
    near = near_names(tools, known).withColumn("severity", F.when(F.col("distance") == 1, "high").otherwise("medium"))
    own = tools.withColumn("__lower", F.lower("name"))
    return own.join(near.withColumnRenamed("name", "__lower"), "__lower").drop("__lower")
