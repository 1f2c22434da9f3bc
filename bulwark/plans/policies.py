"""Queries of the policies over categories of patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bulwark.functions.regex import Rx, quoted
from bulwark.functions.text import sql_hits
from bulwark.operators import policies as po
from bulwark.plans.base import PAYLOADS, PLANTED_SQL, documents, joined, planted, query, sql_any
from bulwark.sources.files import table

#: Log entries appended to documents, so that every kind of sensitive part occurs.
ENTRIES = [
    "Authorization: Bearer abc.DEF-123 token=xyz", "password: hunter2 user=joe", "email=joe@example.com phone: 555-123-4567", "salary = $12,345.67 account_number=123456789",
    "customer_id: 445566 order-number=12345678", "diagnosis: A12.3 medical_record=998877", "ip_address=10.0.0.1 hostname: db-1.local", "GET /index.html status 200",
    "at run (/srv/app/main.js:10:5)", "ssn: 123-45-6789 secret=s3cr3t",
]
#: Claims appended to documents.
SAYINGS = [
    "According to research, 45 percent of people may agree.", "The study found that sales increased by 12.", "The company announced new data this week.",
    "The paper published yesterday says exactly 3 million.", "Perhaps the number of cases is lower.", "A quiet evening in the garden.",
]


def ended(spark: SparkSession, sf_dir: str, endings: list[str]) -> DataFrame:
    """``doc_id, t``: documents with one of the endings."""
    tail = F.element_at(F.array(*map(F.lit, endings)), (F.col("doc_id") % len(endings) + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", F.concat("text", F.lit(" "), tail).alias("t"))


def ended_sql(endings: list[str]) -> str:
    return f"SELECT doc_id, text || ' ' || [{', '.join(map(quoted, endings))}][CAST(doc_id % {len(endings)} + 1 AS INTEGER)] AS t FROM documents"


def _sum(tests: list[str]) -> str:
    return " + ".join(f"CAST({t} AS INTEGER)" for t in tests)


def _highest(levels: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(levels[s])} THEN '{s}'" for s in ("critical", "high", "medium") if s in levels) + " ELSE 'low' END"


def _levels(of: dict, column: str = "n_{}") -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name, (severity, *_) in of.items():
        out.setdefault(severity, []).append(column.format(name) + " > 0")
    return out


_ADVICE = ", ".join(f"{_sum([Rx(p, 'i').sql() for p in patterns])} AS n_{name}" for name, (_, patterns) in po.ADVICE.items())
_TYPES = "list_filter([" + ", ".join(f"CASE WHEN n_{n} > 0 THEN '{n}' END" for n in po.ADVICE) + "], lambda x: x IS NOT NULL)"
_CONFIDENCE = " + ".join(f"least(n_{n} / 3.0::DOUBLE, 1)" for n in po.ADVICE)


@query("regulated_advice", f"WITH d AS ({PLANTED_SQL}), c AS (SELECT doc_id, {_ADVICE} FROM d) SELECT doc_id, {joined(_TYPES)} AS types, round({_CONFIDENCE}, 9) AS confidence, {_highest(_levels(po.ADVICE))} AS severity FROM c")
def regulated_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = planted(spark, sf_dir).select("doc_id", po.regulated_advice(F.col("t")).alias("r"))
    confidence = F.aggregate("r.types", F.lit(0.0), lambda a, x: a + x["confidence"])
    return found.select("doc_id", F.array_join("r.types.type", ", ").alias("types"), F.round(confidence, 9).alias("confidence"), "r.severity")


_ROLES = {name: " OR ".join(Rx(p, "i").sql() for p in patterns) for name, (_, _, patterns) in po.HIERARCHY.items()}
_RISK = " + ".join(f"CASE WHEN {t} THEN {c * (po.SEVERITIES.index(s) + 1)!r}::DOUBLE ELSE 0 END" for (s, c, _), t in zip(po.HIERARCHY.values(), _ROLES.values(), strict=True))
_ROLE_LEVELS: dict[str, list[str]] = {}
for _name, (_severity, _, _) in po.HIERARCHY.items():
    _ROLE_LEVELS.setdefault(_severity, []).append(f"({_ROLES[_name]})")
_HEADED = f"SELECT doc_id, [{', '.join(map(quoted, PAYLOADS))}][CAST(doc_id % {len(PAYLOADS)} + 1 AS INTEGER)] || ' ' || text AS t FROM documents"


@query("hierarchy_violations", f"WITH d AS ({_HEADED}) SELECT doc_id, {joined(sql_any(_ROLES))} AS violations, round({_RISK}, 9) AS risk, {_highest(_ROLE_LEVELS)} AS severity FROM d")
def hierarchy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(*map(F.lit, PAYLOADS)), (F.col("doc_id") % len(PAYLOADS) + 1).cast("int"))
    found = documents(spark, sf_dir).select("doc_id", po.hierarchy_violations(F.concat(head, F.lit(" "), F.col("text"))).alias("r"))
    return found.select("doc_id", F.array_join("r.violations", ", ").alias("violations"), F.round("r.risk", 9).alias("risk"), "r.severity")


_COUNTS = ", ".join(f"{' + '.join(Rx(p, 'i').sql_count() for p in patterns)} AS n_{name}" for name, (_, _, patterns) in po.ENDINGS.items())
_SURE = {name: f"n_{name} > 0 AND n_{name} / (length(t) / 100.0::DOUBLE) >= {po.ENDING_CONFIDENCE}" for name, (_, at_once, _) in po.ENDINGS.items() if at_once}
_REASON = "CASE " + " ".join(f"WHEN {t} THEN '{name}'" for name, t in reversed(_SURE.items())) + " END"
_CATEGORIES = "list_filter([" + ", ".join(f"CASE WHEN n_{n} > 0 THEN '{n}' END" for n in po.ENDINGS) + "], lambda x: x IS NOT NULL)"


@query("stream_ending", f"WITH d AS ({PLANTED_SQL}), c AS (SELECT doc_id, t, {_COUNTS} FROM d) SELECT doc_id, {joined(_CATEGORIES)} AS categories, {_highest(_levels(po.ENDINGS))} AS severity, {_REASON} AS reason FROM c")
def stream_ending(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = planted(spark, sf_dir).select("doc_id", po.ending(F.col("t")).alias("r"))
    return found.select("doc_id", F.array_join("r.categories", ", ").alias("categories"), "r.severity", "r.reason")


_WINDOW_MS, _MOST_MS = 48 * 3_600_000, 20 * 86_400_000


@query("stream_endings", f"""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS micros, [{', '.join(map(quoted, PAYLOADS))}][CAST(event_id % {len(PAYLOADS)} + 1 AS INTEGER)] AS t FROM events),
c AS (SELECT *, {_COUNTS} FROM e), k AS (SELECT *, len({_CATEGORIES}) AS n, {_REASON} AS reason FROM c),
w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY micros RANGE BETWEEN {_WINDOW_MS * 1000 - 1} PRECEDING AND 1 PRECEDING), 0) AS recent, min(micros) OVER (PARTITION BY user_id) AS first FROM k)
SELECT event_id, CASE WHEN reason IS NOT NULL THEN reason WHEN length(t) > 10000 THEN 'length' WHEN micros - first > {_MOST_MS * 1000} THEN 'duration' WHEN recent >= 3 THEN 'consecutive' END AS ends FROM w""")
def stream_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, PAYLOADS)), (F.col("event_id") % len(PAYLOADS) + 1).cast("int"))
    parts = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("stream_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), text.alias("text"))
    return po.stream_endings(parts, _WINDOW_MS, _MOST_MS).select("event_id", "ends")


@query("factual_claims", f"WITH d AS ({ended_sql(SAYINGS)}) SELECT doc_id, " + ", ".join(f"CAST({' + '.join(Rx(p, 'i').sql_count() for p in patterns)} AS INTEGER) AS {kind}" for kind, patterns in po.CLAIMS.items()) + f", {sql_hits(po.HEDGES)} > 0 AS hedged FROM d")
def factual_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ended(spark, sf_dir, SAYINGS)
    return rows.select("doc_id", *[c.alias(kind) for kind, c in po.claims(F.col("t")).items()], po.hedged(F.col("t")).alias("hedged"))


@query("claim_confidence")
def claim_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What surrounds a claim is beyond RE2; a test holds it against brute force."""
    return ended(spark, sf_dir, SAYINGS).select("doc_id", po.claim_confidence(F.col("t")).alias("r")).select("doc_id", "r.unhedged", F.round("r.score", 9).alias("score"), "r.risk")


@query("log_counts", f"WITH d AS ({ended_sql(ENTRIES)}) SELECT doc_id, " + ", ".join(f"CAST({' + '.join(Rx(p, 'i').sql_count() for p in patterns)} AS INTEGER) AS {kind}" for kind, (_, patterns) in po.LOG_DATA.items()) + " FROM d")
def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ended(spark, sf_dir, ENTRIES).select("doc_id", *[c.alias(kind) for kind, c in po.log_counts(F.col("t")).items()])


@query("log_redacted")
def log_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of matches are beyond SQL's replacement; a test holds it against brute force."""
    return po.redacted_logs(ended(spark, sf_dir, ENTRIES), "t").select("doc_id", F.md5("redacted").alias("redacted"))


_TOTAL = " + ".join(Rx(p, "i").sql_count() for _, patterns in po.LOG_DATA.values() for p in patterns)
_FAULTS = f"[CASE WHEN length(t) > {po.LOG_LENGTH} THEN 'Log entry too long: ' || length(t) || ' characters' END, CASE WHEN n > 0 THEN 'Sensitive data detected: ' || n || ' items' END, CASE WHEN {Rx(po.STACK_TRACE).sql()} THEN 'Stack traces not allowed for this log level' END, CASE WHEN {Rx(po.FILE_PATH).sql()} THEN 'File paths not allowed for this log level' END]"


@query("log_compliance", f"WITH d AS ({ended_sql(ENTRIES)}), c AS (SELECT doc_id, t, {_TOTAL} AS n FROM d) SELECT doc_id, {joined('list_filter(' + _FAULTS + ', lambda x: x IS NOT NULL)')} AS violations, CASE WHEN n > {po.LOG_REDACTIONS} THEN 'low' WHEN n > 0 OR length(t) > {po.LOG_LENGTH} THEN 'medium' ELSE 'high' END AS compliance FROM c")
def log_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ended(spark, sf_dir, ENTRIES).select("doc_id", po.log_compliance(F.col("t")).alias("r"))
    return found.select("doc_id", F.array_join("r.violations", ", ").alias("violations"), "r.compliance")
