from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bulwark.errors import ExecutionFailed
from bulwark.functions import backoff
from bulwark.operators import output_checks as oc
from bulwark.operators import retry as rt

SCHEMA = "id long, prompt string, max_output_tokens int, need int"


def model(spark):
    """A model that says ``bad`` until its ``need``-th attempt, fails where ``need`` is negative, and counts its calls."""
    calls = spark.sparkContext.accumulator(0)

    def generate(df):
        def each(batches):
            for batch in batches:
                calls.add(len(batch))
                batch["output"] = ["good enough" if n <= a else "bad" for n, a in zip(batch["need"].abs(), batch["attempt"])]
                batch["error"] = ["busy" if n < 0 and a < -n else None for n, a in zip(batch["need"], batch["attempt"])]
                yield batch

        return df.mapInPandas(each, df.schema)

    return generate, calls


def test_only_blocked_rows_go_round(spark):
    rows = spark.createDataFrame([(k, f"p{k}", None, k % 5) for k in range(50)] + [(0, "p0", None, 0)], SCHEMA)
    generate, calls = model(spark)
    waits = []
    out = rt.retried(rows, generate, [oc.blocked_content(["bad"])], max_retries=3, adjust=rt.improved(200, "Go on."), backoff=backoff.exponential(100), pause=waits.append)
    got = {(r.id, r.prompt.split("\n")[0]): r for r in out.collect()}
    assert out.count() == 51  # counted again without another call
    assert calls.value == 51 + 40 + 30 + 20 and waits == [100.0, 200.0, 400.0]
    for k in range(50):
        r, need = got[(k, f"p{k}")], k % 5
        assert r.attempts == min(need, 3) + 1 and r.blocked == (need > 3) and not r.failed
        assert r.waited_ms == [0, 100, 300, 700, 700][need]
        assert [h.attempt for h in r.history] == list(range(r.attempts)) and [h.blocked for h in r.history] == [True] * (r.attempts - 1) + [need > 3]
        assert r.output == ("bad" if need > 3 else "good enough") and r.max_output_tokens == (None if need == 0 else 400 + 200 * min(need, 3))
        assert r.prompt.count("Note: Blocked content detected: bad. Go on.") == min(need, 3)
    with pytest.raises(ExecutionFailed, match="exhausted after 3"):
        rt.retried(rows, generate, [oc.blocked_content(["bad"])], max_retries=3, exhausted="throw")


def test_errors(spark):
    rows = spark.createDataFrame([(1, "p", None, -1), (2, "q", None, 0), (3, "r", None, -9)], SCHEMA)
    generate, calls = model(spark)
    got = {r.id: r for r in rt.retried(rows, generate, [], max_retries=2, retry_errors=lambda e, n: (e == "busy") & (n < 2)).collect()}
    assert (got[1].output, got[1].attempts, got[1].blocked) == ("good enough", 2, False)
    assert [h.message for h in got[1].history] == ["Generation error: busy", None]
    assert (got[3].output, got[3].attempts, got[3].blocked, got[3].failed) == (None, 3, True, True)
    assert calls.value == 3 + 2 + 1
    assert {r.id: (r.attempts, r.failed) for r in rt.retried(rows, generate, [], max_retries=2).collect()} == {1: (1, True), 2: (1, False), 3: (1, True)}


def test_no_rows_and_null_outputs(spark):
    rows = spark.createDataFrame([(1, "p", None, 0)], SCHEMA)
    silent = lambda df: df.withColumn("output", F.lit(None).cast("string"))
    assert rt.retried(rows.limit(0), silent, [oc.min_length(1)]).count() == 0
    r = rt.retried(rows.withColumn("history", F.lit(3)), silent, [oc.min_length(1)], adjust=rt.instructed(), max_retries=1).first()
    assert r.blocked and r.attempts == 2 and r.output is None
    with pytest.raises(ValueError):
        rt.retried(rows, silent, [], exhausted="never")
