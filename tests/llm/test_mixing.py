from __future__ import annotations

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from bulwark.llm import mixing


def targets(sizes):
    """Water filling by repetition."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped, out = sum(sizes.values()), {}, {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        out = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if out[s] >= 3 * sizes[s]]
        if not over:
            return out | capped
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_targets_and_taken(docs):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randint(1, 60), "en", rng.choice(["a", "b", "b", "b", "b", "c", "dd", None])) for k in range(4000)]
    rows += [(9000 + k, "w", "en", "tiny") for k in range(3)] + [(9100, None, "en", "zero")]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    total = defaultdict(int)
    for i, _, _, s in rows:
        total[s] += size[i]
    want = targets(dict(total))
    got = mixing.mix_report(docs(rows)).collect()
    assert len(got) == len(rows)
    taken, source = defaultdict(int), {r[0]: r[3] for r in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == total[s] and abs(r.target - want[s]) < 1e-6
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(60, 0.01 * want[s]) for s in total)
    again = {r.doc_id: r.taken for r in mixing.mix_report(docs(rows).repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_documents_are_repeated(docs):
    rows = [(k, "a b c", "en", "small") for k in range(5)] + [(100 + k, "a b c d", "en", "large") for k in range(500)]
    df = docs(rows)
    want = {r.doc_id: r.taken // r.size for r in mixing.mix_report(df).collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert out.filter(F.col("size") != -1).count() == 0


def test_edges(docs, edge_rows):
    assert mixing.mix_report(docs(edge_rows)).count() == len(edge_rows)
    assert mixing.mix_report(docs([])).count() == 0
    assert mixing.mix_report(docs([(1, None, None, None)])).first().target == 0


def test_long_documents_and_odd_columns(spark):
    """Sizes over four orders of magnitude stay near the target; maps and clashing names do no harm."""
    rng = random.Random(4)
    rows = [(k, "w " * int(10 ** rng.uniform(0, 4)), rng.choice("aab"), {"k": str(k)}, k, k, "x") for k in range(1500)]
    rows += rows[:2]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row map<string,string>, copies long, size long, doc string").repartition(4)
    report = mixing.mix_report(df).groupBy(F.col("size") >= 0).agg(F.sum("taken").alias("t"), F.sum("size").alias("s")).first()
    assert abs(report.t - report.s) <= 2 * 10_000
    out = mixing.mixed_documents(df)
    assert out.schema == df.schema
    assert all(r.doc_id == r.copies for r in out.collect())
