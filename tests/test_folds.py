"""Folds that are split within a key, against folds of one row after another."""

from __future__ import annotations

import random
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from bulwark.operators import folds as fo
from bulwark.operators import sessions as ss


def anchored(times, window, inclusive=False, limit=None):
    """Count and window start at each time, one event after another."""
    out, start, count = [], None, 0
    for t in times:
        if start is None or t - start > window or inclusive and t - start == window:
            start, count = t, 0
        count = count + 1 if limit is None or count < limit else count
        denied = limit is not None and out and out[-1][1] == start and out[-1][0] >= limit
        out.append((limit + 1 if denied else count, start))
    return out


def bucket(times, rate, capacity, cost):
    tokens, last, out = Fraction(capacity), None, []
    for t in times:
        if last is not None:
            tokens = min(Fraction(capacity), tokens + Fraction(t - last, 1_000_000) * Fraction(rate).limit_denominator(10**6))
        last, ok = t, tokens >= Fraction(cost)
        tokens -= Fraction(cost) if ok else 0
        out.append((ok, float(tokens)))
    return out


def recent(times, window, most):
    return [min(most, sum(1 for u in times[: k + 1] if t - u < window)) for k, t in enumerate(times)]


def some_times(rng, n):
    gaps = rng.choice([[0, 1], [1], [0, 1, 2, 3, 50], [5, 7], [0, 0, 0, 30], [3]])
    t, out = 0, []
    for _ in range(n):
        t += rng.choice(gaps) * 1_000_000
        out.append(t)
    return out


def test_anchored_windows():
    assert anchored([0, 5, 10, 11, 21, 22], 10) == [(1, 0), (2, 0), (3, 0), (1, 11), (2, 11), (1, 22)]
    assert [c for c, _ in anchored([0, 10], 10, inclusive=True)] == [1, 1]
    assert [c for c, _ in anchored([0, 1, 2, 3], 10, limit=2)] == [1, 2, 3, 3]


def test_pieces_compose():
    """A fold through tables of pieces, cut anywhere, is the fold of the whole; and that is the one made step by step."""
    rng = random.Random(0)
    for _ in range(800):
        times = some_times(rng, rng.randint(1, 40))
        cuts = sorted(rng.sample(range(len(times) + 1), rng.randint(0, min(5, len(times)))))
        w, rate, cap, cost = rng.choice([1, 3, 10, 60]) * 1_000_000, rng.choice([0, 0.1, 0.5, 1 / 3, 2]), rng.choice([1, 2, 3, 5.5]), rng.choice([1, 0.5, 2, 0])
        cases = [
            (fo.Anchored(w), [*zip(*((s, c) for c, s in anchored(times, w)))]), (fo.Anchored(w, True), [*zip(*((s, c) for c, s in anchored(times, w, True)))]),
            (fo.Bucket(rate, cap, cost), [*zip(*bucket(times, rate, cap, cost))]), (fo.Recent(w, 3), [recent(times, w, 3)]),
        ]
        for fold, want in cases:
            state, outs = None, []
            for part in np.split(np.array(times), cuts):
                if not len(part):
                    continue
                table = fold.table(part)
                assert table.lows == sorted(set(table.lows))
                after, out = fold.run(part, state)
                assert fold.leave(table, state, fold.enter(state, int(part[0])), int(part[-1])) == after
                state = after
                outs.append(out)
            for got, one in zip((np.concatenate(o) for o in zip(*outs)), want, strict=True):
                assert np.allclose(got, np.array(one, float), atol=1e-9)


def test_tables_stay_small():
    busy = np.arange(20_000) * 1_000_000
    assert len(fo.Anchored(60_000_000).table(busy).lows) <= 62
    assert len(fo.Bucket(0.7, 100, 1).table(busy).lows) <= 103
    assert len(fo.Bucket(0.7, 100, 1).table(np.cumsum(np.random.default_rng(0).integers(1, 2_000_000, 20_000))).lows) <= 103


def test_what_a_bucket_takes():
    for wrong in ((-1, 2, 1), (1, 0, 1), (1, 2, -1), (1 / 999_983, 10**9, 1)):
        with pytest.raises(ValueError):
            fo.Bucket(*wrong)
    with pytest.raises(ValueError):
        fo.Recent(5, 1)


@pytest.fixture
def tiny_pieces(monkeypatch):
    monkeypatch.setattr(fo, "SHIFT", 3)


def rows_of(rng):
    rows = [(k, "busy", t, "é") for k, t in enumerate(some_times(rng, 400))] + [(1000 + k, rng.choice(["a", "b", "c", None]), rng.randint(0, 90) * 1_000_000, None) for k in range(120)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_keys_over_many_pieces(spark, tiny_pieces, seed):
    rows = rows_of(random.Random(seed))
    df = spark.createDataFrame(rows, "event_id long, user string, micros long, note string").repartition(5)
    by = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        by.setdefault(r[1], []).append(r)
    want = {}
    for rs in by.values():
        times = [r[2] for r in rs]
        for r, *x in zip(rs, anchored(times, 10_000_000), anchored(times, 10_000_000, True, 2), bucket(times, 0.3, 2, 1), recent(times, 10_000_000, 3)):
            want[r[0]] = (r[3], x)
    for k, out in enumerate([
        ss.anchored_counts(df, "user", "micros", 10, ["event_id"]).select("event_id", "note", "count", "window_start"), ss.anchored_counts(df, "user", "micros", 10, ["event_id"], True, 2).select("event_id", "note", "count", "window_start"),
        ss.token_bucket(df, "user", "micros", 0.3, 2, order=["event_id"]).select("event_id", "note", "allowed", "tokens"), ss.user_escalation(df.withColumn("s", F.lit(0.9)), "user", "micros", "s", 3, 10, order=["event_id"]).select("event_id", "note", "recent"),
    ]):
        got = {r[0]: (r[1], tuple(r[2:])) for r in out.collect()}
        assert len(got) == len(rows)
        for i, (note, values) in want.items():
            assert got[i][0] == note
            assert got[i][1] == pytest.approx(values[k] if isinstance(values[k], tuple) else (values[k],)), (k, i)


def test_rows_without_a_time_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a", None, 2**60 + 1), (2, "a", 5, None), (3, None, 6, 7)], "event_id long, user string, micros long, big long")
    got = {r.event_id: (r["count"], r.window_start, r.big) for r in ss.anchored_counts(df, "user", "micros", 60).collect()}
    assert got == {1: (None, None, 2**60 + 1), 2: (1, 5, None), 3: (1, 6, 7)}
    assert ss.token_bucket(df.limit(0), "user", "micros", 1, 2).count() == 0


def test_escalation_of_a_user(spark):
    rows = [("u", t * 1_000_000, s) for t, s in ((0, 0.5), (100, 0.9), (200, 0.96), (299, 0.1), (500, None))]
    got = ss.user_escalation(spark.createDataFrame(rows, "u string, m long, s double"), "u", "m", "s").orderBy("m").collect()
    assert [(r.recent, r.needs_cooldown, r.cooldown_left, r.needs_review, r.blocked) for r in got] == [
        (1, False, 0.0, False, False), (2, False, 0.0, True, False), (3, True, 300.0, True, True), (3, True, 300.0, False, False), (2, False, 0.0, False, False),
    ]


def test_one_key_of_millions_without_a_pause(spark):
    """Five million events of one key, a second apart: no pause, and windows that never fall in step with the pieces."""
    n = 5_000_000
    df = spark.range(n).select(F.lit("busy").alias("user"), (F.col("id") * 1_000_000).alias("micros"))
    begin = time.time()
    out = ss.anchored_counts(df, "user", "micros", 60)
    wrong = (F.col("count") != F.col("micros") / 1_000_000 % 61 + 1) | (F.col("window_start") != F.col("micros") - (F.col("count") - 1) * 1_000_000)
    assert tuple(out.agg(F.count("*"), F.count_if(wrong), F.count_if(F.col("count").isNull())).first()) == (n, 0, 0)
    assert time.time() - begin < 240
