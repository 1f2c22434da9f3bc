from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from bulwark.llm import importance as im

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def features(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute(docs, bench, percent=25, least=20):
    corpus, target = Counter(), Counter()
    for _, t in docs:
        corpus.update(features(t))
    for t in bench:
        target.update(features(t))
    n, m = sum(corpus.values()), sum(target.values())
    out = []
    for i, t in docs:
        fs = features(t)
        weight = sum(math.floor(1000 * math.log((target[f] + 1) * (n + 10000) / ((corpus[f] + 1) * (m + 10000)))) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in out if r[1] >= 2 * least - 1), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def got(spark, docs, bench, **options):
    df = spark.createDataFrame([(*r, 1, 2, "x", b"y") for r in docs], "doc_id long, text string, score long, rank long, stream string, offsets binary").repartition(3)
    target = spark.createDataFrame([(t, 5) for t in bench], "text string, doc_id long")
    return sorted(map(tuple, im.importance_resample(df, target, **options).select(COLUMNS).collect()), key=str)


def corpus(rng, n):
    words = [f"w{k}" for k in range(200)] + ["Élan", "漢字", "it's", "A_B", "x-9"]
    return [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(n)]


@pytest.mark.parametrize("pack", [64, 4 << 20])
def test_equals_brute_force(spark, monkeypatch, pack):
    rng = random.Random(1)
    monkeypatch.setattr(im.packs, "__defaults__", (im.BUCKETS, pack))
    docs, bench = corpus(rng, 300), [t for _, t in corpus(rng, 12)]
    want = brute(docs, bench)
    assert got(spark, docs, bench) == want and sum(r[4] is not None for r in want) > 30


def test_edges(spark, edge_rows):
    docs = [r[:2] for r in edge_rows] + [(9, "one two " * 15)] * 9 + [(None, "b c " * 20)] * 2
    assert got(spark, docs, ["a b c d", None, ""]) == brute(docs, ["a b c d", None, ""])
    assert got(spark, docs, []) == brute(docs, [])
    assert got(spark, [], ["a b"]) == []


def test_slices(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice(["a", "B", "é", " ", "  ", "\n", "long" * 9, "_"]) for _ in range(5000))
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(im, "SLICE", size)
        assert sorted(im.buckets(text).tolist()) == sorted(features(text))


def test_draw_resembles_the_target(spark):
    rng = random.Random(5)
    kinds = {"near": [f"n{k}" for k in range(8)], "far": [f"f{k}" for k in range(8)]}  # few words, so that counts outweigh the smoothing
    docs = [(k, " ".join(rng.choice(kinds["near" if k % 4 == 0 else "far"]) for _ in range(40))) for k in range(800)]
    bench = [" ".join(rng.choice(kinds["near"]) for _ in range(40)) for _ in range(30)]
    drawn = [r[0] for r in got(spark, docs, bench) if r[4] is not None]
    assert len(drawn) == 200 and np.mean([i % 4 == 0 for i in drawn]) > 0.85
    df = spark.createDataFrame([(*d, "kept") for d in docs], "doc_id long, text string, more string")
    rows = im.drawn_documents(df, spark.createDataFrame([(t,) for t in bench], "text string")).collect()
    assert sorted(r.doc_id for r in rows) == sorted(drawn) and rows[0].more == "kept"


def test_ranks_of_ties(spark):
    rows = [(k, 39, 0, k % 3) for k in range(90)] + [(k, 38, 0, 9) for k in range(5)]
    out = im.ranked(spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long").repartition(4)).collect()
    order = [r.doc_id for r in sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])]
    assert len(out) == 95 and order == [k for k in range(90) if k % 3 == 2][:22]


def test_same_as_sql(spark):
    rng = random.Random(6)
    docs, bench = corpus(rng, 120) + [(500, None), (501, ""), (None, "word " * 30)], [t for _, t in corpus(rng, 5)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute("CREATE TABLE benchmark (text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?)", [(t,) for t in bench])
    relation = con.sql(im.SQL)
    at = [relation.columns.index(c) for c in COLUMNS]
    assert sorted((tuple(r[k] for k in at) for r in relation.fetchall()), key=str) == brute(docs, bench)
