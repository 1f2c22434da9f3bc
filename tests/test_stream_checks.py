"""Checks of streams: automata against whole texts, live against batch."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from bulwark.functions import text as tx
from bulwark.functions.regex import Rx
from bulwark.operators import output_checks as oc
from bulwark.operators.check import Scope
from bulwark.streaming import checked as ck
from bulwark.streaming import parts as sp
from bulwark.streaming.automaton import Scanner, count_words

PIECES = [
    "kill", "ing", " ", "AKIA", "ABCDEFGHIJKLMNOP", "123", "-", "45", "6789", "a@b.co", "m", "Bearer ", "\n", "api_key=", "x" * 20, "eyJa.eyJb.", "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----",
    "street", "é", "😀", "redis://u:p@h", "secret: ", "4111 ", "1111", "want to die", "harm someone", "I think", " it is probab", "ly, ", "according", " to", "studies show", "toxic harm", "ful", "offensive", "inappropriate ",
    "ladies", "patient", "source:", "Password", "", None, " ", "K",
]
PAIRS = [
    (ck.max_length(60), oc.max_length(60)), (ck.min_length(25), oc.min_length(25)), (ck.sensitive_data(), oc.sensitive_data()), (ck.blocked_content(["Ly, acc", "street"]), oc.blocked_content(["Ly, acc", "street"])),
    (ck.confidence_threshold(0.6), oc.confidence_threshold(0.6)), (ck.toxicity_filter(0.5), oc.toxicity_filter(0.5)), (ck.hallucination_detector(0.4), oc.hallucination_detector(0.4)), (ck.bias_detector(), oc.bias_detector()),
    (ck.factual_accuracy(True), oc.factual_accuracy(True)), (ck.privacy_leakage(), oc.privacy_leakage()), (ck.compliance(["gdpr", "HIPAA", "none"]), oc.compliance(["gdpr", "HIPAA", "none"])), (ck.secret_detector(), oc.secret_detector()),
    (ck.unsafe_content(), oc.unsafe_content()),
]


def streams(rng, n, most=9):
    return [(f"s{k}", i, "".join(x for x in rng.choices(PIECES, k=rng.randint(0, 3)) if x) or rng.choice(["", None])) for k in range(n) for i in range(rng.randint(1, most))]


def test_scanner_finds_what_patterns_find():
    rng = random.Random(1)
    rxs = [rx for rx, _ in oc.SENSITIVE.values()] + list(oc.PRIVACY.values()) + list(oc.SECRETS.values()) + [r for v in oc.UNSAFE.values() for r in v]
    rxs += [Rx("^kill"), Rx("m$"), Rx("^m$", "m"), Rx("a.b", "s"), Rx("(?:ab|ba){2,3}c?"), Rx("[^a-z]{3}", "i"), Rx(r"\Bing\b"), Rx("")]
    scan = Scanner(rxs)
    for _ in range(150):
        carried, sure, text = [], 0, ""
        for _ in range(6):
            part = "".join(x or "" for x in rng.choices(PIECES, k=rng.randint(0, 3)))
            text += part
            carried, found, now = scan.scan(carried, part)
            sure |= found
            for k, rx in enumerate(rxs):
                flags = re.A | (re.I if "i" in rx.flags else 0) | (re.S if "s" in rx.flags else 0) | (re.M if "m" in rx.flags else 0)
                source = rx.source.replace(r"\s", "[\\s ]") if "[" not in rx.source else rx.source
                want = re.search(source.replace("m$", r"m\Z") if "m" not in rx.flags else source, text, flags) is not None
                assert bool((sure | now) >> k & 1) == want or " " in text or "K" in text, (rx, text)


def test_scanner_state_is_bounded(monkeypatch):
    scan = Scanner(oc.SECRETS.values())
    carried, _, _ = scan.scan([], "eyJa" * 50_000)
    assert len(carried) <= len(scan.free) + 1
    monkeypatch.setattr("bulwark.streaming.automaton.STATES", 1)
    assert scan.scan(carried, ".eyJb.c")[2] & 1 << [*oc.SECRETS].index("JWT Token")
    with pytest.raises(ValueError):
        Scanner([Rx("a(?=b)")])


def test_words_across_parts():
    rng = random.Random(2)
    for _ in range(300):
        ps = ["".join(rng.choice("ab \n ") for _ in range(rng.randint(0, 4))) for _ in range(5)]
        total, inside = 0, False
        for p in ps:
            n, inside = count_words(p, inside)
            total += n
        assert total == len(re.findall("[ab]+", "".join(ps)))


def test_same_as_checks_of_the_text_so_far(spark):
    """Every check, after every part of 150 streams, decides as its Column form does over the accumulated text."""
    rows = streams(random.Random(3), 150)
    df = spark.createDataFrame(rows, "stream_id string, seq long, delta string").repartition(3)
    scope = Scope(F.col("so_far"))
    want = sp.accumulated(df.withColumn("delta", F.coalesce("delta", F.lit("")))).select("stream_id", "seq", *[check(scope).alias(f"c{k}") for k, (_, check) in enumerate(PAIRS)]).collect()
    got = {(r.stream_id, r.seq): r.violations for r in ck.checked_parts(df, ck.Monitor(tuple(c for c, _ in PAIRS), mode="progressive")).collect()}
    hits = set()
    for r in want:
        names = [r[f"c{k}"].guardrail_name for k in range(len(PAIRS)) if r[f"c{k}"].triggered]
        assert got[(r.stream_id, r.seq)] == names, (r.stream_id, r.seq)
        hits |= {*names}
    assert len(got) == len(rows) and len(hits) == len(PAIRS)
    # messages and severities of a single check
    for stream, column in (PAIRS[2], PAIRS[3], PAIRS[6], PAIRS[9]):
        one = sp.accumulated(df.withColumn("delta", F.coalesce("delta", F.lit("")))).select("stream_id", "seq", column(scope).alias("c")).filter("c.triggered").collect()
        first = {}
        for r in sorted(one, key=lambda r: r.seq):
            first.setdefault(r.stream_id, (r.seq, f"Guardrail violation: {r.c.message}"))
        stopped = {r.stream_id: (r.seq, r.error) for r in ck.checked_parts(df, ck.Monitor((stream,), severity="low")).filter("error IS NOT NULL").collect()}
        assert stopped == first


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_ways_to_end(spark):
    df = spark.createDataFrame([("a", k, d, t) for k, (d, t) in enumerate([("so ", "text-delta"), (None, "tool"), ("tox", "text-delta"), ("ic and ", "text-delta"), ("harmful", "text-delta"), (" more", "text-delta"), ("x", "finish")])], "stream_id string, seq long, delta string, type string")
    check = ck.StreamCheck("bad", lambda s: ("high", "two") if len(s.found) > 1 else ("medium", "one") if s.found else None, ("toxic", "harmful"))
    run = lambda **o: [tuple(r)[1:] for r in sorted(ck.checked_parts(df, ck.Monitor((check,), **o)).collect(), key=lambda r: r.seq)]
    passed = [(0, "so ", None, []), (1, None, None, []), (2, "tox", None, [])]
    assert run() == [*passed, (3, "ic and ", None, ["bad"]), (4, "harmful", None, ["bad"]), (5, " more", None, ["bad"]), (6, "x", None, [])]  # nothing critical
    assert run(severity="high") == [*passed, (3, "ic and ", None, ["bad"]), (4, None, "Guardrail violation: two", ["bad"])]
    assert run(severity="medium", every=2) == [*passed, (3, "ic and ", None, []), (4, None, "Guardrail violation: two", ["bad"])]
    assert run(mode="progressive", until=True)[3:] == [(3, "ic and ", None, ["bad"]), (4, "[Output blocked: two]", None, ["bad"])]
    assert run(mode="progressive", until=1, replace=False)[3:] == [(3, "ic and ", None, ["bad"])]
    assert run(mode="progressive", until=lambda counts: counts[2] >= 2)[4:] == [(4, "harmful", None, ["bad"]), (5, "[Output blocked: two]", None, ["bad"])]
    assert len(run(mode="progressive")) == 7
    assert ck.checked_parts(df.limit(0), ck.Monitor((check,))).count() == 0
    with pytest.raises(ValueError):
        ck.Monitor((check,), mode="sometimes")


def test_live_equals_batch(spark, tmp_path):
    """Five micro-batches of parts through the state store end as one pass over all of them does."""
    rows = streams(random.Random(4), 40, 12)
    schema = "stream_id string, seq long, delta string"
    folder = tmp_path / "in"
    for cut in range(5):
        spark.createDataFrame([r for r in rows if cut * 3 <= r[1] < cut * 3 + 3] or [("none", cut, "")], schema).coalesce(1).write.mode("append").parquet(str(folder))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for name, monitor in (("live_stop", ck.Monitor((ck.sensitive_data(), ck.toxicity_filter(0.2)), severity="high")), ("live_progressive", ck.Monitor((ck.unsafe_content(), ck.max_length(50)), mode="progressive", until=True))):
            live = ck.checked_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)), monitor)
            query = live.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
            assert query.awaitTermination(180) and query.exception() is None
            batch = ck.checked_parts(spark.read.schema(schema).parquet(str(folder)), monitor)
            assert rows_of(spark.table(name)) == rows_of(batch)
            assert len(query.recentProgress) >= 5
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_measures_of_the_text_so_far(spark):
    rows = streams(random.Random(5), 60)
    df = spark.createDataFrame(rows, "stream_id string, seq long, delta string")
    full = F.coalesce("delta", F.lit(""))
    want = sp.accumulated(df.withColumn("delta", full)).select("stream_id", "seq", tx.length16(F.col("so_far")).alias("a"), tx.count_words(F.col("so_far")).alias("b"), tx.estimate_tokens(F.col("so_far")).alias("c"))
    assert rows_of(sp.measured(df).select("stream_id", "seq", "length", "words", "tokens")) == rows_of(want)
    some = df.withColumn("delta", full)
    assert rows_of(sp.token_budget(some, 9).select("stream_id", "seq", "delta", "stopped")) == rows_of(sp.token_budget(some, 9, tx.estimate_tokens).select("stream_id", "seq", "delta", "stopped"))
    assert rows_of(sp.token_aware_checks(some, 6)) == rows_of(sp.token_aware_checks(some, 6, tx.estimate_tokens))
