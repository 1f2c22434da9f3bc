from __future__ import annotations

import hashlib
import random
import re

from bulwark.llm.exact_dedup import exact_groups


def brute(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for norm, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        for m in members:
            i = None if m[1] else m[2]
            out.append((i, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, block):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = exact_groups(df, block).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)
    kept = {}
    for r in got:
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_small_blocks(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("ab \n") for _ in range(n)) for n in (0, 1, 3, 4, 5, 8, 9, 40, 41, 63)]
    rows = [(k, rng.choice(base) + " " * rng.randint(0, 2)) for k in range(60)] + [(k, rng.choice(base)[:-1] + "c") for k in range(60, 80)]
    check(spark, rows, 4)


def test_edges(spark, edge_rows):
    check(spark, [r[:2] for r in edge_rows] + [(9, "x" * 59999 + "y"), (10, "x" * 60000), (None, None)], 4096)


def test_empty(spark):
    assert exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
