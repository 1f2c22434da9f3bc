"""Queries over sessions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bulwark.functions import text as tx
from bulwark.operators import output_checks as oc
from bulwark.operators import sessions as ss
from bulwark.plans.base import documents, query, sql_any
from bulwark.sources.files import table
from bulwark.streaming import checked, parts

KEY, ORDER = ["user_id"], ["micros", "event_id"]
EVENTS_SQL = "SELECT event_id, user_id, event_type, value, epoch_us(ts) AS micros, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return rows.withColumn("step", F.row_number().over(ss.W.partitionBy("user_id").orderBy("micros", "event_id")))


@query("budget_running", f"""WITH e AS ({EVENTS_SQL}), r AS (SELECT event_id, sum(round(value)) OVER w AS total_cost, count(*) FILTER (event_type = 'purchase') OVER w AS total_calls FROM e WINDOW w AS (PARTITION BY user_id ORDER BY micros, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, total_cost, CAST(total_calls AS BIGINT) AS total_calls, total_cost > 500 OR total_calls > 5 AS stopped FROM r""")
def budget_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("cost_usd", F.round("value")).withColumn("tokens", F.lit(1)).withColumn("is_tool", F.col("event_type") == "purchase").withColumn("is_error", F.col("event_type") == "error")
    return ss.budget(e, KEY, ORDER, max_cost=500.0, max_calls=5).select("event_id", "total_cost", "total_calls", "stopped")


_V = f"e AS ({EVENTS_SQL}), v AS (SELECT *, CASE WHEN value > 90 THEN 'critical' WHEN value > 50 THEN 'high' ELSE 'low' END AS severity FROM e WHERE event_type = 'error')"


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("value") > 90, "critical").when(F.col("value") > 50, "high").otherwise("low")
    return events(spark, sf_dir).filter("event_type = 'error'").withColumn("severity", severity)


@query("stop_conditions", f"""WITH {_V} SELECT event_id, max(severity = 'critical') OVER w AS any_critical, count(*) OVER w >= 3 AS three, count(*) FILTER (severity = 'high') OVER w >= 2 AS two_high,
(count(*) OVER w >= 3 OR max(severity = 'critical') OVER w) AS agent FROM v WINDOW w AS (PARTITION BY user_id ORDER BY micros, event_id ROWS UNBOUNDED PRECEDING)""")
def stop_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sev = F.col("severity")
    return violations(spark, sf_dir).select(
        "event_id", ss.any_critical(KEY, ORDER, sev).alias("any_critical"), ss.violation_count(KEY, ORDER, 3).alias("three"),
        ss.severity_count(KEY, ORDER, sev, "high", 2).alias("two_high"), ss.agent_stop(KEY, ORDER, sev).alias("agent"),
    )


@query("consecutive_violations", f"WITH {_V} SELECT event_id, coalesce(step - lag(step, 1) OVER (PARTITION BY user_id ORDER BY micros, event_id) = 1, false) AS stop FROM v")
def consecutive_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(spark, sf_dir).select("event_id", ss.consecutive(KEY, ORDER, F.col("step"), 2).alias("stop"))


_S = "count(*) FILTER (event_type = 'error') OVER w"


@query("prepare_step", f"""WITH e AS ({EVENTS_SQL}), r AS (SELECT event_id, CAST({_S} AS BIGINT) AS recent, coalesce(max(event_type = 'error' AND value > 90) OVER w, false) AS stop FROM e WINDOW w AS (PARTITION BY user_id ORDER BY step RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING))
SELECT *, CASE WHEN recent > 0 THEN 0.39999999999999997::DOUBLE ELSE 0.7::DOUBLE END AS temperature FROM r""")
def prepare_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("v", (F.col("event_type") == "error").cast("int")).withColumn("c", (F.col("event_type") == "error") & (F.col("value") > 90))
    return ss.prepare_step(e, KEY, "step", "v", "c").select("event_id", "recent", "stop", "temperature")


@query("adaptive_step", f"WITH e AS ({EVENTS_SQL}), r AS (SELECT event_id, CAST({_S} AS BIGINT) AS recent FROM e WINDOW w AS (PARTITION BY user_id ORDER BY step RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)) SELECT event_id, recent, round(greatest(0.1::DOUBLE, 0.7::DOUBLE - 0.15::DOUBLE * recent), 9) AS temperature, recent >= 2 AS stop FROM r")
def adaptive_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("v", (F.col("event_type") == "error").cast("int"))
    return ss.adaptive_step(e, KEY, "step", "v", escalate_after=2).select("event_id", "recent", F.round("temperature", 9).alias("temperature"), "stop")


HOUR = 6 * 3600


def fold_sql(restart: str, rows: str = "SELECT * FROM e") -> str:
    """A fold over each user's ordered rows, as a recursive query."""
    return f"""WITH RECURSIVE e AS ({EVENTS_SQL}), x AS (SELECT event_id, user_id, micros, event_type, row_number() OVER (PARTITION BY user_id ORDER BY micros, event_id) AS k FROM ({rows})),
f AS (SELECT user_id, k, event_id, micros, micros AS start, CAST(1 AS BIGINT) AS n FROM x WHERE k = 1
UNION ALL SELECT x.user_id, x.k, x.event_id, x.micros, CASE WHEN {restart} THEN x.micros ELSE f.start END, CASE WHEN {restart} THEN CAST(1 AS BIGINT) ELSE f.n + 1 END FROM f JOIN x ON x.user_id = f.user_id AND x.k = f.k + 1)"""


@query("rate_limit_fixed", fold_sql(f"x.micros - f.start > {HOUR * 1_000_000}") + f" SELECT event_id, n AS count, n > 2 AS limited, CASE WHEN n > 2 THEN least({HOUR * 1000} - (micros - start) // 1000 + 1000, 30000) END AS retry_ms FROM f")
def rate_limit_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "user_id", "micros")
    return ss.rate_limited(e, "user_id", "micros", 2, HOUR, ORDER).select("event_id", "count", "limited", F.col("retry_ms").cast("long").alias("retry_ms"))


@query("gradual_enforcement", fold_sql(f"x.micros - f.start > {4 * HOUR * 1_000_000}", "SELECT * FROM e WHERE event_type = 'error'") + " SELECT event_id, n AS count, CASE WHEN n <= 1 THEN 'warn' WHEN n > 2 THEN 'block' ELSE 'warn-elevated' END AS phase FROM f")
def gradual_enforcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    warn, block, _ = ss.ESCALATIONS["strict"]
    rows = violations(spark, sf_dir).select("event_id", "user_id", "micros", "severity")
    return ss.escalated(rows, "user_id", "micros", warn, block, 4 * HOUR, ORDER).select("event_id", "count", "phase")


@query("rate_limit_strict", f"""WITH RECURSIVE e AS ({EVENTS_SQL}), x AS (SELECT event_id, user_id, micros, row_number() OVER (PARTITION BY user_id ORDER BY micros, event_id) AS k FROM e),
f AS (SELECT user_id, k, event_id, micros AS start, CAST(1 AS BIGINT) AS n, CAST(1 AS BIGINT) AS c FROM x WHERE k = 1
UNION ALL SELECT x.user_id, x.k, x.event_id, CASE WHEN x.micros - f.start >= {HOUR * 1_000_000} THEN x.micros ELSE f.start END,
CASE WHEN x.micros - f.start >= {HOUR * 1_000_000} THEN CAST(1 AS BIGINT) ELSE least(f.n + 1, 2) END,
CASE WHEN x.micros - f.start >= {HOUR * 1_000_000} THEN CAST(1 AS BIGINT) ELSE f.n + 1 END FROM f JOIN x ON x.user_id = f.user_id AND x.k = f.k + 1)
SELECT event_id, c AS count, c > 2 AS limited FROM f""")
def rate_limit_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "user_id", "micros")
    return ss.strict_rate_limited(e, "user_id", "micros", 2, HOUR, ORDER).select("event_id", "count", "limited")


@query("token_bucket", f"""WITH RECURSIVE e AS ({EVENTS_SQL}), x AS (SELECT event_id, user_id, micros, row_number() OVER (PARTITION BY user_id ORDER BY micros, event_id) AS k FROM e),
f AS (SELECT user_id, k, event_id, micros, CAST(3 AS DOUBLE) AS had FROM x WHERE k = 1
UNION ALL SELECT x.user_id, x.k, x.event_id, x.micros, least(3::DOUBLE, f.had - CASE WHEN f.had >= 1 THEN 1 ELSE 0 END + (x.micros - f.micros) / 1000000::DOUBLE * (1 / 20000::DOUBLE)) FROM f JOIN x ON x.user_id = f.user_id AND x.k = f.k + 1)
SELECT event_id, had >= 1 AS allowed, round(had - CASE WHEN had >= 1 THEN 1 ELSE 0 END, 6) AS tokens FROM f""")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "user_id", "micros")
    return ss.token_bucket(e, "user_id", "micros", 1 / 20000, 3, order=ORDER).select("event_id", "allowed", F.round("tokens", 6).alias("tokens"))


@query("user_escalation", f"""WITH {_V} SELECT event_id, least(count(*) OVER (PARTITION BY user_id ORDER BY micros, event_id ROWS UNBOUNDED PRECEDING) - coalesce(old, 0), 3) AS recent,
count(*) OVER (PARTITION BY user_id ORDER BY micros, event_id ROWS UNBOUNDED PRECEDING) - coalesce(old, 0) >= 3 AS needs_cooldown, value >= 85 AS needs_review, value >= 95 AS blocked
FROM v LEFT JOIN (SELECT a.event_id, count(*) AS old FROM v AS a JOIN v AS b ON a.user_id = b.user_id AND b.micros <= a.micros - {12 * HOUR * 1_000_000} GROUP BY a.event_id) USING (event_id)""")
def user_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = violations(spark, sf_dir).select("event_id", "user_id", "micros", "value")
    out = ss.user_escalation(rows, "user_id", "micros", "value", 3, 12 * HOUR, review=85, block=95, order=ORDER)
    return out.select("event_id", "recent", "needs_cooldown", "needs_review", "blocked")


@query("grace_period", "SELECT event_id, event_type = 'error' AND ts >= TIMESTAMP '2024-01-15' AS triggered FROM events")
def grace_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", ss.graced(F.col("event_type") == "error", F.col("ts"), F.lit("2024-01-15").cast("timestamp_ntz")).alias("triggered"))


@query("sliding_violations_72h", f"WITH {_V} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY micros RANGE BETWEEN {12 * HOUR * 1_000_000} PRECEDING AND CURRENT ROW) AS n FROM v")
def sliding_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    # errors are rare here, so the sliding window is long
    return violations(spark, sf_dir).select("event_id", ss.sliding_count(KEY, F.col("micros"), 12 * HOUR).alias("n"))


@query("plan_so_far", f"WITH e AS ({EVENTS_SQL}) SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY micros, event_id ROWS UNBOUNDED PRECEDING), ',') AS plan FROM e")
def plan_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("tools", F.array("event_type"))
    return ss.plan_so_far(e, KEY, ORDER, "tools").select("event_id", F.array_join("plan", ",").alias("plan"))


CHUNKS_SQL = "SELECT CAST(conv_id AS VARCHAR) AS stream_id, turn AS seq, text || CASE WHEN turn = 3 AND conv_id % 2 = 0 THEN ' forbidden' ELSE '' END AS delta FROM conversations"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when((F.col("turn") == 3) & (F.col("conv_id") % 2 == 0), " forbidden").otherwise("")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), F.concat("text", mark).alias("delta"))


def stop_sql(bad: str) -> str:
    return f"""WITH p AS ({CHUNKS_SQL}), a AS (SELECT *, string_agg(delta, '' ORDER BY seq) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS t FROM p),
b AS (SELECT *, max({bad}) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS stop, max({bad}) OVER (PARTITION BY stream_id) AS stopped FROM a)
SELECT stream_id, seq, delta, stopped FROM b WHERE NOT stop"""


@query("stream_stop_accumulated", stop_sql("contains(lower(t), 'forbidden')"))
def stream_stop_accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.content_filter(chunks(spark, sf_dir), ["Forbidden"])


@query("token_budget_stream", stop_sql("ceil(length(t) / 4.0::DOUBLE + len(regexp_extract_all(t, '[^\\s]+')) / 2.0::DOUBLE) > 120"))
def token_budget_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.token_budget(chunks(spark, sf_dir), 120)


@query("stream_every_second_part", f"""WITH p AS ({CHUNKS_SQL}), a AS (SELECT *, string_agg(delta, '' ORDER BY seq) OVER w AS t, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS n FROM p WINDOW w AS (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, contains(t, 'forbidden') AND n % 2 = 0 AS bad FROM a), b AS (SELECT *, max(bad) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS stop, max(bad) OVER (PARTITION BY stream_id) AS stopped FROM c)
SELECT stream_id, seq, delta, stopped FROM b WHERE NOT stop""")
def stream_every_second_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.every_kth(chunks(spark, sf_dir), F.contains("so_far", F.lit("forbidden")), 2)


@query("stream_buffered", f"SELECT stream_id, string_agg(delta, '' ORDER BY seq) AS text FROM ({CHUNKS_SQL}) GROUP BY stream_id")
def stream_buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.buffered(chunks(spark, sf_dir))


@query("stream_dropped_parts", f"SELECT stream_id, seq, CASE WHEN contains(delta, 'forbidden') THEN '[FILTERED]' ELSE delta END AS delta FROM ({CHUNKS_SQL})")
def stream_dropped_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.handled(chunks(spark, sf_dir), F.contains("delta", F.lit("forbidden")), "replace")


_FOUND = {n: rx.sql("t") for n, (rx, _) in oc.SENSITIVE.items()}
_WATCH = f"""WITH p AS ({CHUNKS_SQL}), q AS (SELECT stream_id, seq, delta || CASE WHEN seq = 4 AND CAST(stream_id AS BIGINT) % 3 = 0 THEN ' mail a@b.co, ssn 123-4' WHEN seq = 5 THEN '5-6789 is toxic, harmful and offens' ELSE '' END AS delta FROM p),
a AS (SELECT *, string_agg(delta, '' ORDER BY seq) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS t FROM q),
k AS (SELECT *, {sql_any(_FOUND)} AS kinds, contains(lower(t), 'forbidden') AS word, (contains(lower(t), 'toxic')::INT + contains(lower(t), 'harmful')::INT + contains(lower(t), 'offensive')::INT + contains(lower(t), 'inappropriate')::INT) * 0.3::DOUBLE > 0.7::DOUBLE AS toxic FROM a),
n AS (SELECT *, list_filter([CASE WHEN len(kinds) > 0 THEN 'Sensitive data detected: ' || array_to_string(kinds, ', ') END, CASE WHEN word THEN 'Blocked content detected: forbidden' END, CASE WHEN toxic THEN 'Content toxicity score exceeds threshold' END], lambda x: x IS NOT NULL) AS said,
  list_filter([CASE WHEN len(kinds) > 0 THEN 'sensitive-data-filter' END, CASE WHEN word THEN 'blocked-content' END, CASE WHEN toxic THEN 'toxicity-filter' END], lambda x: x IS NOT NULL) AS names,
  word OR toxic OR len(list_filter(kinds, lambda k: k NOT IN ('Email', 'Phone'))) > 0 AS high FROM k)"""


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams with data that only shows where two parts meet."""
    more = F.when((F.col("seq") == 4) & (F.col("stream_id").cast("long") % 3 == 0), " mail a@b.co, ssn 123-4").when(F.col("seq") == 5, "5-6789 is toxic, harmful and offens").otherwise("")
    return chunks(spark, sf_dir).withColumn("delta", F.concat("delta", more))


WATCH = (checked.sensitive_data(), checked.blocked_content(["forbidden"]), checked.toxicity_filter())


@query("stream_checked", _WATCH + """, s AS (SELECT *, sum(high::INT) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS so_far FROM n)
SELECT stream_id, seq, CASE WHEN NOT high THEN delta END AS delta, CASE WHEN high THEN 'Guardrail violation: ' || array_to_string(said, ', ') END AS error, array_to_string(names, ',') AS violations FROM s WHERE so_far - high::INT = 0""")
def stream_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = checked.checked_parts(watched(spark, sf_dir), checked.Monitor(WATCH, severity="high"))
    return out.withColumn("violations", F.array_join("violations", ","))


@query("stream_progressive", _WATCH + """, s AS (SELECT *, count(*) FILTER (len(names) > 0) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS so_far FROM n)
SELECT stream_id, seq, CASE WHEN so_far = 2 AND len(names) > 0 THEN '[Output blocked: ' || array_to_string(said, ', ') || ']' ELSE delta END AS delta, array_to_string(names, ',') AS violations FROM s WHERE so_far < 2 OR so_far = 2 AND len(names) > 0""")
def stream_progressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = checked.checked_parts(watched(spark, sf_dir), checked.Monitor(WATCH, mode="progressive", until=2))
    return out.select("stream_id", "seq", "delta", F.array_join("violations", ",").alias("violations"))


@query("token_aware_checks", f"""WITH RECURSIVE p AS ({CHUNKS_SQL}), a AS (SELECT stream_id, seq, delta, string_agg(delta, '' ORDER BY seq) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS t, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS k FROM p),
x AS (SELECT stream_id, seq, delta, k, ceil(length(t) / 4.0::DOUBLE + len(regexp_extract_all(t, '[^\\s]+')) / 2.0::DOUBLE)::BIGINT AS n FROM a),
f AS (SELECT stream_id, k, seq, delta, n >= 40 AS checked, CASE WHEN n >= 40 THEN n ELSE 0 END AS last FROM x WHERE k = 1
UNION ALL SELECT x.stream_id, x.k, x.seq, x.delta, x.n - f.last >= 40, CASE WHEN x.n - f.last >= 40 THEN x.n ELSE f.last END FROM f JOIN x ON x.stream_id = f.stream_id AND x.k = f.k + 1)
SELECT stream_id, seq, delta, checked FROM f""")
def token_aware_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.token_aware_checks(chunks(spark, sf_dir), 40)


_RED = "text || ' 123-45-6789 and 555-123-4567'"
for _rx in parts.REDACTED.values():
    _RED = f"regexp_replace({_RED}, '{_rx.re2}', '[REDACTED]', 'g')"


@query("pii_redaction_stream", f"SELECT doc_id, md5({_RED}) AS redacted FROM documents")
def pii_redaction_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(parts.redacted(F.concat("text", F.lit(" 123-45-6789 and 555-123-4567")))).alias("redacted"))


@query("conversation_context", "SELECT conv_id, md5(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role <> 'system'), '')) AS prompt, coalesce(first(text ORDER BY turn) FILTER (role = 'system'), '') AS system FROM conversations GROUP BY conv_id")
def conversation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bulwark.plans.checks import conversations

    c = conversations(spark, sf_dir).select("conv_id", tx.normalized_context(F.col("messages")).alias("c"))
    return c.select("conv_id", F.md5("c.prompt").alias("prompt"), F.col("c.system").alias("system"))
