from __future__ import annotations

import random
import string

import pytest
from pyspark.sql import functions as F

from bulwark.operators import names as nm


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, s, n):
    for _ in range(n):
        at = rng.randint(0, len(s))
        s = rng.choice([s[:at] + rng.choice("ab_é") + s[at:], s[:at] + s[at + 1 :], s[:at] + rng.choice("ab_") + s[at + 1 :]])
    return s


@pytest.mark.parametrize("edits", [1, 2])
def test_equals_comparing_all(spark, edits):
    rng = random.Random(edits)
    known = ["".join(rng.choice("ab_") for _ in range(rng.choice([0, 1, 2, 5, 9, 22, 23, 24, 25, 26, 27, 40]))) for _ in range(60)]
    names = [edited(rng, rng.choice(known), rng.randint(0, 4)) for _ in range(250)] + ["", "AB", "x" * 3000, known[0].upper()]
    want = {(a, b, distance(a, b)) for a in {n.lower() for n in names} for b in set(known) if abs(len(a) - len(b)) <= edits and 1 <= distance(a, b) <= edits}
    df = spark.createDataFrame([(n, 1) for n in [*names, *names, None]], "name string, distance int")
    got = nm.near_names(df, spark.createDataFrame([(k,) for k in [*known, None]], "known string"), edits).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(len(a) > nm.LONG >= len(b) for a, b, _ in want) and any(min(len(a), len(b)) > nm.LONG for a, b, _ in want)


def test_tools(spark):
    known = spark.createDataFrame([("read_file",), ("search",)], "known string")
    tools = spark.createDataFrame([("read_flie", "x"), ("searc", "y"), ("Search", "z"), ("weather", "w"), ("searc", "again")], "name string, description string")
    got = sorted(map(tuple, nm.typosquats(tools, known).select("name", "description", "known", "severity").collect()))
    assert got == [("read_flie", "x", "read_file", "medium"), ("searc", "again", "search", "high"), ("searc", "y", "search", "high")]
    assert nm.near_names(tools.limit(0), known).count() == 0
    with pytest.raises(ValueError):
        nm.near_names(tools, known, 3)


def test_no_cross_join(spark):
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).substr(1, 8).alias("name"))
    df = nm.near_names(rows, rows.withColumnRenamed("name", "known"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
