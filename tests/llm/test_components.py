from __future__ import annotations

import glob
import random

import pytest

from bulwark.llm.common import checkpointed
from bulwark.llm.components import components


@pytest.mark.parametrize("most", [20, 10**6])
def test_roots(spark, most):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in [*root]}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(9), most).collect()}
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "u long, v long"), most).count() == 0


def test_path_and_star(spark):
    """A long path over many partitions, and one node with very many neighbours."""
    path = spark.range(3000).selectExpr("id u", "id + 1 v")
    star = spark.range(5000, 25000).selectExpr("id u", "if(id % 2 = 0, 4500, 90000) v").union(spark.createDataFrame([(4500, 90000)], "u long, v long"))
    got = components(path.union(star).repartition(13), 100).groupBy("root").count().collect()
    assert sorted((r.root, r["count"]) for r in got) == [(0, 3001), (4500, 20002)]


def test_few_files(spark):
    """Edges that are written are not written again, and a round of few edges is one file."""
    edges = checkpointed(spark.range(400).selectExpr("id u", "id + 1 v").repartition(9))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(glob.glob(f"{folder}/*/part-*"))
    got = components(edges, written=True).groupBy("root").count().collect()
    assert [(r.root, r["count"]) for r in got] == [(0, 401)]
    assert len({*glob.glob(f"{folder}/*/part-*")} - before) == 1
