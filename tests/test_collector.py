from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bulwark.operators import collector as co

SCHEMA = "execution_id long, guardrail string, triggered boolean, severity string, is_error boolean, ms double, ts timestamp"
START = datetime(2024, 1, 1)


def executions(spark, n=20_000):
    rng = random.Random(7)
    rows = [(k, rng.choice("ggggggh"), rng.random() < 0.3, rng.choice(["low", "high", "critical", None]), rng.random() < 0.1, rng.lognormvariate(3, 1) if rng.random() < 0.98 else None, START + timedelta(seconds=rng.randint(0, 7200))) for k in range(n)]
    return spark.createDataFrame([*rows, (-1, "g", False, None, False, 1.0, None)], SCHEMA).repartition(6), rows


def test_slices_add_up(spark):
    df, rows = executions(spark)
    minutes = co.slices(df, 60).cache()
    direct = {r.guardrail: r for r in co.summarised(co.merged(co.slices(df, 10**9))).collect()}
    for parts in (minutes, co.merged(minutes, F.date_trunc("hour", "slice").alias("slice"))):
        for r in co.summarised(co.merged(parts)).collect():
            for c in ("executions", "blocked", "errors", "blocked_low", "blocked_medium", "blocked_high", "blocked_critical", "timed", "least_ms", "most_ms", "first_seen", "last_seen", "last_violation", "block_rate", "error_rate"):
                assert r[c] == direct[r.guardrail][c], c
            assert r.mean_ms == pytest.approx(direct[r.guardrail].mean_ms)
    assert minutes.filter("slice IS NULL").select("executions").first()[0] == 1
    g = [r for r in rows if r[1] == "g"]
    assert direct["g"].executions == len(g) + 1 and direct["g"].blocked_medium == sum(r[2] and r[3] is None for r in g) and direct["g"].last_violation == max(r[6] for r in g if r[2])
    total = co.totals(minutes).first()
    assert (total.executions, total.period_end) == (len(rows) + 1, max(r[6] for r in rows))


def test_ranks_of_quantiles(spark):
    """The rank of a returned quantile, merged from 120 slices, is off by less than one in a hundred."""
    df, rows = executions(spark)
    for r in co.summarised(co.merged(co.slices(df, 60))).collect():
        times = sorted(x[5] for x in rows if x[1] == r.guardrail and x[5] is not None)
        for p in (0.5, 0.95, 0.99):
            got = r[f"p{int(p * 100)}_ms"]
            below, upto = sum(t < got for t in times) / len(times), sum(t <= got for t in times) / len(times)
            assert below - 0.01 <= p <= upto + 0.01, (r.guardrail, p)


def test_samples_of_parts(spark):
    df, rows = executions(spark, 4000)
    whole = {(r.guardrail, r.execution_id) for r in co.sample(df, 50).collect()}
    parts = co.sample(df.filter("ms < 20"), 50).unionByName(co.sample(df.filter("ms >= 20"), 50))
    assert {(r.guardrail, r.execution_id) for r in co.sample(parts, 50).collect()} == whole and len(whole) == 100
    assert "WindowGroupLimit" in co.sample(df, 50)._jdf.queryExecution().executedPlan().toString()
    share = co.slices(df, 60, share=0.25).agg(F.sum("executions")).first()[0]
    assert 0.2 < share / len(rows) < 0.3


def test_nothing_timed_and_nothing_at_all(spark):
    row = spark.createDataFrame([(1, "g", True, None, True, None, START)], SCHEMA)
    got = co.summarised(co.merged(co.slices(row))).first()
    assert (got.executions, got.timed, got.p95_ms, got.mean_ms) == (1, 0, None, None)
    assert co.merged(co.slices(row.limit(0))).count() == 0 and co.sample(row, 5).count() == 0


def test_live_slices(spark, tmp_path):
    df, _ = executions(spark, 500)
    dated = df.filter("ts IS NOT NULL")
    dated.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    query = co.live_slices(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 60, "0 seconds").writeStream.format("memory").queryName("slices_live").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    got = spark.table("slices_live")
    last = dated.agg(F.max("ts")).first()[0]
    want = co.slices(dated, 60).filter(F.col("slice") + F.expr("INTERVAL 60 SECONDS") <= F.lit(last))
    key = ["guardrail", "slice", "executions", "blocked", "timed"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect())) and got.count() > 50
