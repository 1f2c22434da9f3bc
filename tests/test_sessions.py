from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bulwark.errors import ConfigurationError, ValidationFailed
from bulwark.functions import backoff
from bulwark.operators import evaluation as ev
from bulwark.operators import governance, registry
from bulwark.operators import sessions as ss
from bulwark.operators.check import Scope
from bulwark.sources import files
from bulwark.streaming import parts, stateful


def test_budget_stops_for_good(spark):
    rows = spark.createDataFrame([("s", 1, 0.6, 1, True, False), ("s", 2, 0.6, 1, True, False), ("s", 3, -5.0, 1, True, False)], "k string, seq int, cost_usd double, tokens long, is_tool boolean, is_error boolean")
    got = [r.stopped for r in ss.budget(rows, ["k"], ["seq"], max_cost=1.0).orderBy("seq").collect()]
    assert got == [False, True, True]


def test_folds(spark):
    rows = spark.createDataFrame([("a", t * 1_000_000, "high") for t in (0, 1, 2, 70)], "k string, m long, severity string")
    assert [r.limited for r in ss.rate_limited(rows, "k", "m", 2).orderBy("m").collect()] == [False, False, True, False]
    assert [r.phase for r in ss.escalated(rows, "k", "m", 1, 2, 60).orderBy("m").collect()] == ["warn", "warn-elevated", "block", "warn"]
    assert [r.allowed for r in ss.token_bucket(rows, "k", "m", 0.1, 2).orderBy("m").collect()] == [True, True, False, True]
    assert [r.stop for r in ss.custom_condition(rows, "k", ["m"], lambda v: len(v) > 2).orderBy("m").collect()] == [False, False, True, True]


CHUNKS = [("s", k, d) for k, d in enumerate(["all ", "is ", "for", "bidden ", "here"])] + [("t", 0, "fine")]


def test_stream_parts(spark):
    df = spark.createDataFrame(CHUNKS, "stream_id string, seq long, delta string")
    text = lambda out: "".join(r.delta for r in out.filter("stream_id = 's'").orderBy("seq").collect())
    assert text(parts.content_filter(df, ["Forbidden"])) == "all is for"
    assert text(parts.every_kth(df, F.contains("so_far", F.lit("forbidden")), 5)) == "all is forbidden "
    assert parts.buffered(df).filter("stream_id = 's'").first().text == "all is forbidden here"
    assert text(parts.handled(df, F.contains("delta", F.lit("is")), "drop")) == "all forbidden here"
    assert spark.createDataFrame([("a@b.co 123-45-6789",)], "d string").select(parts.redacted(F.col("d"))).first()[0] == "[REDACTED] [REDACTED]"
    assert text(parts.token_budget(df, 3)) == "all is "


def streamed(spark, df, tmp_path, transform, name):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # idle timeouts would ask for batches without end
    path = str(tmp_path / name)
    df.coalesce(1).write.parquet(path)
    q = transform(spark.readStream.schema(df.schema).parquet(path)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / (name + "_c"))).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).toPandas()


def test_structured_streaming_equals_batch(spark, tmp_path):
    chunks = spark.createDataFrame(CHUNKS, "stream_id string, seq long, delta string")
    got = streamed(spark, chunks, tmp_path, lambda s: stateful.stopping_stream(s, ["forbidden"]), "stop_stream")
    want = parts.content_filter(chunks, ["forbidden"]).toPandas()
    pd.testing.assert_frame_equal(got.sort_values(["stream_id", "seq"], ignore_index=True), want[["stream_id", "seq", "delta"]].sort_values(["stream_id", "seq"], ignore_index=True))
    requests = spark.createDataFrame([("a", t * 1_000_000) for t in (0, 1, 2, 70, 71)], "key string, micros long")
    got = streamed(spark, requests, tmp_path, lambda s: stateful.rate_limits(s, 2), "limit_stream")
    want = ss.rate_limited(requests, "key", "micros", 2).toPandas()
    assert got.sort_values("micros")["limited"].tolist() == want.sort_values("micros")["limited"].tolist()
    steps = spark.createDataFrame([("a", k, 0.6) for k in range(3)], "key string, seq long, cost double")
    assert streamed(spark, steps, tmp_path, lambda s: stateful.budgets(s, 1.0), "budget_stream").sort_values("seq")["stopped"].tolist() == [False, True, True]


def test_evaluation(spark):
    rows = [("g", True, True), ("g", True, None), ("g", False, True), ("g", False, False), ("h", None, True)]
    m = ev.confusion(spark.createDataFrame(rows, "guardrail string, expected boolean, actual boolean")).collect()
    assert len(m) == 1 and (m[0].tp, m[0].tn, m[0].fp, m[0].fn) == (1, 1, 1, 1) and m[0].f1 == 0.5
    times = spark.createDataFrame([("g", float(t)) for t in [0, *range(1, 21)]], "g string, ms double")
    s = ev.execution_stats(times, ["g"], "ms").first()
    assert (s.p50, s.p95, s.p99, s.least) == (10.0, 19.0, 20.0, 1.0)


def test_samples(spark, tmp_path):
    data = files.sample_dataset(spark)
    assert data.count() == 6
    files.save_samples(data, str(tmp_path / "s"))
    assert files.load_samples(spark, str(tmp_path / "s")).count() == 6
    (tmp_path / "bad.jsonl").write_text(json.dumps({"id": "x"}) + "\n\nnot json\n")
    with pytest.raises(ValidationFailed) as e:
        files.load_samples(spark, str(tmp_path / "bad.jsonl"))
    assert len(e.value.details["lines"]) == 2
    assert ev.filter_samples(data, ["pii"], ["medium"]).count() == 1
    assert {r.category: r.samples for r in ev.dataset_stats(data).groupBy("category").agg(F.sum("samples").alias("samples")).collect()}["pii"] == 2


def test_registry(spark):
    reg = registry.default_registry(lambda texts: ['{"flagged": true, "confidence": 0.8}' for _ in texts])
    checks = reg.bundle('{"guardrails": [{"name": "Contains PII", "config": {"block": true}}, {"name": "Jailbreak"}]}')
    df = spark.createDataFrame([("mail a@b.co",)], "t string")
    assert [df.select(c(Scope(F.col("t"))).alias("r")).first().r.triggered for c in checks] == [True, True]
    for bad in ("{", [{"config": {}}], {"guardrails": 3}, [{"name": "nope"}], [{"name": "toxicity", "config": {"x": 1}}]):
        with pytest.raises(ConfigurationError):
            reg.bundle(bad)
    assert registry.pipeline_errors({"version": 1, "input": {"guardrails": []}, "later": []}) == ["unknown stage later"]
    assert [len(x) for x in registry.staged({"input": [{"name": "toxicity"}, {"name": "unknown"}], "output": []}, reg)] == [1, 0]
    assert registry.verdict("I say yes", "yes") == (True, 0.5) and registry.verdict("?", None) == (False, 0.0)
    down = registry.judged("Jailbreak", None)
    r = df.select(down(Scope(F.col("t"))).alias("r")).first().r
    assert r.execution_failed and not r.triggered


def test_governance_and_backoff(spark):
    got = spark.sql("select array('a','b') as need, array('a') as have").select(governance.scope_decision(F.col("need"), F.col("have")).alias("d")).first().d
    assert (got.decision, got.missing) == ("deny", "b")
    n = spark.range(1, 5).select(backoff.exponential(100, 2, 500)(F.col("id")).alias("x"))
    assert [r.x for r in n.collect()] == [100.0, 200.0, 400.0, 500.0]
    jittered = spark.range(1, 5).select(backoff.jittered_exponential(100)(F.col("id")).alias("x")).collect()
    assert all(abs(r.x / (100 * 2**k) - 1) <= 0.06 for k, r in enumerate(jittered))
