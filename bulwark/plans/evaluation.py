"""Queries of the engine, of evaluation and of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bulwark.functions import backoff
from bulwark.functions.text import sql_hits
from bulwark.operators import collector, compose, engine, governance, input_checks, output_checks, retry
from bulwark.operators import evaluation as ev
from bulwark.operators.check import Scope
from bulwark.plans.base import documents, query
from bulwark.sources.files import table

CHECKS = [input_checks.length_limit(2000), input_checks.toxicity_detector(0.5), output_checks.min_length(300)]
#: The same three over ``t``: triggered flags in order of priority (toxicity is high, the others medium).
FLAGS = f"SELECT doc_id, {sql_hits(input_checks.TOXIC)} * 0.3::DOUBLE > 0.5 AS a, {sql_hits(input_checks.TOXIC)} * 0.3::DOUBLE > 0.8 AS ac, length(t) > 2000 AS b, length(t) < 300 AS c FROM (SELECT doc_id, text AS t FROM documents)"
N = "(CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER))"


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.guard(documents(spark, sf_dir), "text", CHECKS)


@query("execution_summary", f"WITH f AS ({FLAGS}) SELECT doc_id, 3 AS executed, 3 - {N} AS passed, {N} AS blocked, CAST(a AND ac AS INTEGER) AS failed FROM f")
def execution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guarded(spark, sf_dir).select("doc_id", "summary.executed", "summary.passed", "summary.blocked", "summary.failed")


@query("sequential_results", f"WITH f AS ({FLAGS}) SELECT doc_id, CASE WHEN a THEN 1 WHEN b THEN 2 ELSE 3 END AS executed FROM f")
def sequential_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.guard(documents(spark, sf_dir), "text", CHECKS, sequential=True).select("doc_id", "summary.executed")


@query("highest_severity", f"WITH f AS ({FLAGS}) SELECT doc_id, CASE WHEN a THEN 'toxicity-detector' WHEN b THEN 'input-length-limit' WHEN c THEN 'min-length-requirement' END AS worst FROM f")
def highest_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = engine.selected(F.col("summary"), "highest-severity")
    return guarded(spark, sf_dir).select("doc_id", F.get(worst, F.lit(0))["guardrail_name"].alias("worst"))


@query("pipeline_short_circuit", f"WITH f AS ({FLAGS}) SELECT doc_id, b OR a AS triggered, CASE WHEN b THEN '0' WHEN a THEN '1' END AS stage FROM f")
def pipeline_short_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scope(F.col("text"))
    r = compose.pipeline(CHECKS[0](s), CHECKS[1](s))
    return documents(spark, sf_dir).select("doc_id", r.alias("r")).select("doc_id", "r.triggered", F.try_element_at("r.metadata", F.lit("stage")).alias("stage"))


@query("parallel_any_all", f"WITH f AS ({FLAGS}) SELECT doc_id, a OR b AS any_hit, a AND b AS all_hit FROM f")
def parallel_any_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scope(F.col("text"))
    pair = (CHECKS[0](s), CHECKS[1](s))
    return documents(spark, sf_dir).select("doc_id", compose.parallel(*pair)["triggered"].alias("any_hit"), compose.parallel(*pair, mode="all")["triggered"].alias("all_hit"))


@query("not_guard", f"WITH f AS ({FLAGS}) SELECT doc_id, NOT b AS negated, CASE WHEN doc_id % 2 = 0 THEN b ELSE false END AS conditional, b OR a AS after FROM f")
def not_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scope(F.col("text"))
    long, toxic = CHECKS[0](s), CHECKS[1](s)
    return documents(spark, sf_dir).select(
        "doc_id", compose.negated(long)["triggered"].alias("negated"), compose.when(F.col("doc_id") % 2 == 0, long)["triggered"].alias("conditional"), compose.after(long, toxic)["triggered"].alias("after"),
    )


@query("decision_text", f"WITH f AS ({FLAGS}) SELECT doc_id, {N} > 0 AS blocked, CASE WHEN {N} > 0 THEN '[Input blocked: ' || array_to_string(list_filter([CASE WHEN a THEN 'Toxic content detected' END, CASE WHEN b THEN 'Input ' || length(text) || ' exceeds limit of 2000' END, CASE WHEN c THEN 'Output length ' || length(text) || ' below minimum of 300' END], lambda x: x IS NOT NULL), ', ') || ']' ELSE text END AS final_text, CASE WHEN {N} > 0 THEN 'content_filter' ELSE 'stop' END AS finish FROM f JOIN documents USING (doc_id)")
def decision_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guarded(spark, sf_dir).select("doc_id", "blocked", "final_text", engine.finish_reason(F.col("summary")).alias("finish"))


@query("retry_instruction", f"""WITH f AS ({FLAGS}), s AS (SELECT doc_id, list_filter([CASE WHEN a THEN 'Toxic content detected' END, CASE WHEN b THEN 'Please shorten your input' END, CASE WHEN c THEN 'Output length ' || length(text) || ' below minimum of 300' END], lambda x: x IS NOT NULL) AS said FROM f JOIN documents USING (doc_id))
SELECT doc_id, CASE WHEN len(said) = 1 THEN said[1] ELSE array_to_string(list_transform(said, lambda x, i: i || '. ' || x), chr(10)) END AS instruction FROM s""")
def retry_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guarded(spark, sf_dir).select("doc_id", engine.retry_instruction(F.col("summary")).alias("instruction"))


@query("result_trace", f"WITH f AS ({FLAGS}) SELECT doc_id, 'toxicity-detector' AS guardrail_name, a AS triggered FROM f UNION ALL SELECT doc_id, 'input-length-limit', b FROM f UNION ALL SELECT doc_id, 'min-length-requirement', c FROM f")
def result_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.long_results(guarded(spark, sf_dir), "doc_id").select("doc_id", "guardrail_name", "triggered")


@query("governance_denials", f"WITH f AS ({FLAGS}) SELECT doc_id, 'toxicity-detector' AS resource, 'deny' AS decision FROM f WHERE a UNION ALL SELECT doc_id, 'input-length-limit', 'deny' FROM f WHERE b UNION ALL SELECT doc_id, 'min-length-requirement', 'deny' FROM f WHERE c")
def governance_denials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.denials(guarded(spark, sf_dir), "doc_id").select("doc_id", "resource", "decision")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_id, expected, actual`` of labelled documents, for two checks."""
    rows = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    s = Scope(F.col("text"))
    actual = F.create_map(F.lit("toxicity"), input_checks.toxicity_detector(0.5)(s)["triggered"], F.lit("short"), output_checks.min_length(300)(s)["triggered"])
    expected = F.create_map(F.lit("toxicity"), F.col("toxic") == 1, F.lit("short"), F.col("quality") == 0, F.lit("absent"), F.col("toxic") == 1)
    return rows.select(F.col("doc_id").alias("sample_id"), expected.alias("expected"), actual.alias("actual"))


OUTCOMES = f"""o AS (SELECT guardrail, expected, actual FROM (SELECT doc_id, toxic = 1 AS x, quality = 0 AS y, {sql_hits(input_checks.TOXIC, 'lower(text)')} * 0.3::DOUBLE > 0.5 AS a, length(text) < 300 AS c FROM documents JOIN labels USING (doc_id)),
LATERAL (SELECT unnest(['toxicity', 'short', 'absent']) AS guardrail, unnest([x, y, x]) AS expected, unnest([a, c, NULL]) AS actual)),
m AS (SELECT guardrail, count(*) FILTER (expected AND coalesce(actual, false)) AS tp, count(*) FILTER (NOT expected AND NOT coalesce(actual, false)) AS tn, count(*) FILTER (NOT expected AND coalesce(actual, false)) AS fp, count(*) FILTER (expected AND NOT coalesce(actual, false)) AS fn FROM o GROUP BY guardrail),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0::DOUBLE END AS recall FROM m),
q AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy FROM p)"""
ROUNDED = "round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(accuracy, 9) AS accuracy"


def rounded(df: DataFrame, *more: str) -> DataFrame:
    return df.select("guardrail", *more, *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("evaluation_metrics", f"WITH {OUTCOMES} SELECT guardrail, tp, tn, fp, fn, {ROUNDED} FROM q")
def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.confusion(ev.outcomes_of(labelled(spark, sf_dir))), "tp", "tn", "fp", "fn")


@query("evaluation_accuracy", f"WITH {OUTCOMES} SELECT round(count(*) FILTER (expected = actual) / count(*)::DOUBLE, 9) AS accuracy FROM o WHERE actual IS NOT NULL")
def evaluation_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.overall_accuracy(ev.outcomes_of(labelled(spark, sf_dir))).select(F.round("accuracy", 9).alias("accuracy"))


@query("evaluation_report_topk", f"WITH {OUTCOMES} SELECT guardrail, {ROUNDED} FROM q WHERE f1 < 0.7 ORDER BY q.f1, guardrail LIMIT 5")
def evaluation_report_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.weak_performers(ev.confusion(ev.outcomes_of(labelled(spark, sf_dir)))))


@query("evaluation_samples", f"""WITH d AS (SELECT doc_id, toxic = 1 AS x, quality = 0 AS y, {sql_hits(input_checks.TOXIC, 'lower(text)')} * 0.3::DOUBLE > 0.5 AS a, length(text) < 300 AS c FROM documents JOIN labels USING (doc_id)),
m AS (SELECT doc_id AS sample_id, list_filter([CASE WHEN x THEN 'absent' END, CASE WHEN y <> c THEN 'short' END, CASE WHEN x <> a THEN 'toxicity' END], lambda z: z IS NOT NULL) AS mismatches FROM d) SELECT sample_id, len(mismatches) = 0 AS passed, mismatches FROM m""")
def evaluation_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sample_results(labelled(spark, sf_dir)).select("sample_id", "passed", F.array_sort("mismatches").alias("mismatches"))


_E = "SELECT event_type AS guardrail, value > 40 AS triggered, value > 95 AS is_error, round(value) AS ms, ts FROM events"


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("guardrail"), (v > 40).alias("triggered"), F.when(v > 80, "critical").otherwise("low").alias("severity"), (v > 95).alias("is_error"), F.round(v).alias("ms"), "ts")


@query("guardrail_metrics", f"WITH e AS ({_E}) SELECT guardrail, count(*) AS executions, count(*) FILTER (triggered) AS blocked, count(*) FILTER (is_error) AS errors, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99, round(sum(ms) / count(*), 6) AS mean_ms, round(count(*) FILTER (triggered) / count(*)::DOUBLE, 9) AS block_rate, min(ts) AS first_seen FROM e GROUP BY guardrail")
def guardrail_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ev.guardrail_metrics(executions(spark, sf_dir))
    return m.select("guardrail", "executions", "blocked", "errors", "p95", "p99", F.round("mean_ms", 6).alias("mean_ms"), F.round("block_rate", 9).alias("block_rate"), "first_seen")


_HEALTH = f"WITH e AS ({_E}), m AS (SELECT guardrail, count(*) FILTER (triggered) / count(*)::DOUBLE AS b, count(*) FILTER (is_error) / count(*)::DOUBLE AS x FROM e GROUP BY guardrail), h AS (SELECT guardrail, CASE WHEN x > 0.1 THEN 'unhealthy' WHEN b > 0.3 THEN 'degraded' ELSE 'healthy' END AS status FROM m)"


@query("health_status", _HEALTH + " SELECT * FROM h")
def health_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.health(ev.guardrail_metrics(executions(spark, sf_dir)), block_rate=0.3).select("guardrail", "status")


@query("overall_health", _HEALTH + " SELECT CASE max(CASE status WHEN 'unhealthy' THEN 2 WHEN 'degraded' THEN 1 ELSE 0 END) WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS status FROM h")
def overall_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.overall_health(ev.health(ev.guardrail_metrics(executions(spark, sf_dir)), block_rate=0.3))


@query("execution_stats", "SELECT event_type AS guardrail, round(avg(v), 6) AS mean, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99, min(v) AS least, max(v) AS most FROM (SELECT event_type, round(value) AS v FROM events) WHERE v > 0 GROUP BY 1")
def execution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev.execution_stats(executions(spark, sf_dir), ["guardrail"], "ms")
    return rows.withColumn("mean", F.round("mean", 6))


_N = "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error'"


@query("backoff_delays", f"SELECT event_id, least(1000.0::DOUBLE * pow(2.0::DOUBLE, n - 1), 30000.0::DOUBLE) AS exponential, least(1000.0::DOUBLE * n, 30000.0::DOUBLE) AS linear, 1000.0::DOUBLE AS fixed, CASE WHEN n <= 2 THEN 1000.0::DOUBLE ELSE least(1000.0::DOUBLE * (n - 2), 30000.0::DOUBLE) END AS composite FROM ({_N})")
def backoff_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's errors taken for attempts."""
    n = F.col("n")
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'").withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.select("event_id", backoff.exponential()(n).alias("exponential"), backoff.linear()(n).alias("linear"), backoff.fixed()(n).alias("fixed"), backoff.composite(backoff.fixed(), 2, backoff.linear())(n).alias("composite"))


#: What a stand-in for a model leaves out of its next answers, one after the other.
FORBIDDEN = ["the", "de", "ci", "garden"]


def _answers(text: str) -> str:
    out = [text, f"lower({text})"]
    for word in FORBIDDEN[:3]:
        out.append(f"replace({out[-1]}, '{word}', '')")
    return f"[{out[0]}, {', '.join(out[2:])}]"


_BAD = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(a), '{w}') THEN '{w}' END" for w in FORBIDDEN) + "], lambda x: x IS NOT NULL)"


@query("retry_until_valid", f"""WITH a AS (SELECT doc_id, {_answers("coalesce(text, '')")} AS answers FROM documents), u AS (SELECT doc_id, unnest(answers) AS a, generate_subscripts(answers, 1) AS k FROM a), b AS (SELECT doc_id, k, a, {_BAD} AS bad FROM u),
f AS (SELECT doc_id, coalesce(min(k) FILTER (len(bad) = 0), 4) AS k FROM b GROUP BY doc_id)
SELECT doc_id, md5(a) AS output, CAST(k AS INTEGER) AS attempts, len(bad) > 0 AS blocked, CASE WHEN len(bad) > 0 THEN 'Blocked content detected: ' || bad[1] END AS message, ([0.0, 1000.0, 3000.0, 7000.0][k])::DOUBLE AS waited_ms FROM b JOIN f USING (doc_id, k)""")
def retry_until_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    def generate(df: DataFrame) -> DataFrame:
        text = F.coalesce(F.col("text"), F.lit(""))
        answer, rest = F.when(F.col("attempt") == 0, text), F.lower(text)
        for k, word in enumerate(FORBIDDEN[:3]):
            rest = F.replace(rest, F.lit(word), F.lit(""))
            answer = answer.when(F.col("attempt") == k + 1, rest)
        return df.withColumn("output", answer)

    out = retry.retried(documents(spark, sf_dir), generate, [output_checks.blocked_content(FORBIDDEN)], max_retries=3, backoff=backoff.exponential())
    return out.select("doc_id", F.md5("output").alias("output"), "attempts", "blocked", "message", "waited_ms")


@query("metrics_slices", "WITH e AS (SELECT event_type AS guardrail, value > 40 AS triggered, value > 95 AS is_error, round(value, 1) AS ms, ts FROM events) SELECT guardrail, count(*) AS executions, count(*) FILTER (triggered) AS blocked, count(*) FILTER (is_error) AS errors, min(ms) AS least_ms, max(ms) AS most_ms, max(ts) FILTER (triggered) AS last_violation, count(DISTINCT date_trunc('day', ts)) AS days, true AS ranks_hold FROM e GROUP BY guardrail")
def metrics_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly slices merged to days, and those to one row: exact counters, and quantiles whose ranks are checked."""
    v = F.col("value")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("execution_id"), F.col("event_type").alias("guardrail"), (v > 40).alias("triggered"), F.lit("high").alias("severity"), (v > 95).alias("is_error"), F.round("value", 1).alias("ms"), F.col("ts").cast("timestamp").alias("ts"),
    )
    days = collector.merged(collector.slices(rows, 3600), F.date_trunc("day", "slice").alias("slice"))
    whole = collector.summarised(collector.merged(days)).join(days.groupBy("guardrail").agg(F.count("*").alias("days")), "guardrail")
    ranks = rows.join(whole.select("guardrail", "p50_ms", "p95_ms", "p99_ms"), "guardrail").groupBy("guardrail").agg(*[
        F.abs(F.avg((F.col("ms") <= F.col(f"p{p}_ms")).cast("int")) - p / 100).alias(f"off_{p}") for p in (50, 95, 99)
    ])
    out = whole.join(ranks.select("guardrail", (F.greatest("off_50", "off_95", "off_99") < 0.02).alias("ranks_hold")), "guardrail")
    return out.select("guardrail", "executions", "blocked", "errors", "least_ms", "most_ms", F.col("last_violation").cast("timestamp_ntz").alias("last_violation"), "days", "ranks_hold")
