"""Queries of the worked examples' operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bulwark.functions.regex import Rx, quoted
from bulwark.functions.text import sql_hits
from bulwark.operators import facts, input_checks, retention
from bulwark.operators import scoring as sc
from bulwark.operators import sql_policy
from bulwark.plans.base import PLANTED_SQL, documents, joined, planted, query
from bulwark.plans.tools import HOST_SQL
from bulwark.sources.files import table


def _score_sql() -> str:
    parts = [f"{sql_hits(sc.INJECTION_WORDS)} * 2"]
    for name, (weight, patterns) in sc.INJECTION.items():
        tests = [Rx(p, "i").sql() for p in patterns]
        if name == "codeInjection":
            tests += [Rx("```.*\\n.*```", "s").sql(), Rx("<script.*>.*</script>", "is").sql()]
        parts.append(f"CASE WHEN {' OR '.join(tests)} THEN {weight} ELSE 0 END")
    parts += ["CASE WHEN contains(t, '```') AND contains(t, 'system') THEN 5 ELSE 0 END", "CASE WHEN contains(t, '<script') OR contains(t, 'javascript:') THEN 8 ELSE 0 END"]
    return " + ".join(parts)


@query("injection_score", f"WITH d AS ({PLANTED_SQL}) SELECT doc_id, CAST(s AS INTEGER) AS score, CASE WHEN s >= 20 THEN 'critical' WHEN s >= 15 THEN 'high' WHEN s >= 10 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT doc_id, {_score_sql()} AS s FROM d)")
def injection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).select("doc_id", sc.injection_score(F.col("t")).alias("r")).select("doc_id", "r.score", "r.risk")


def _jailbreak_sql() -> str:
    parts = [f"{sql_hits(sc.JAILBREAK_WORDS)} * 3"]
    parts += [f"CASE WHEN {Rx(p, 'i').sql()} THEN {weight} ELSE 0 END" for weight, patterns in sc.JAILBREAK.values() for p in patterns]
    return " + ".join(parts + [f"CASE WHEN contains(t, '{a}') AND contains(t, '{b}') THEN {w} ELSE 0 END" for a, b, w in sc.JAILBREAK_PAIRS])


@query("jailbreak_score", f"WITH d AS ({PLANTED_SQL}) SELECT doc_id, CAST(s AS INTEGER) AS score, CASE WHEN s >= 25 THEN 'critical' WHEN s >= 18 THEN 'high' WHEN s >= 10 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT doc_id, {_jailbreak_sql()} AS s FROM d)")
def jailbreak_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).select("doc_id", sc.jailbreak_score(F.col("t")).alias("r")).select("doc_id", "r.score", "r.risk")



@query("topic", f"WITH d AS ({PLANTED_SQL}) SELECT doc_id, CASE " + " ".join(f"WHEN {sql_hits(w)} > 0 THEN '{t}'" for t, w in sc.TOPICS.items()) + " ELSE 'general' END AS topic FROM d")
def topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).select("doc_id", sc.topic(F.col("t")).alias("topic"))


@query("quality_assessment", "WITH d AS (SELECT doc_id, text AS t FROM documents), s AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[.!?]+'), lambda x: regexp_matches(x, '\\S')) AS p FROM d), q AS (SELECT doc_id, [CASE WHEN length(t) < 20 THEN 'Response too short' END, CASE WHEN " + sql_hits(sc.GENERIC) + " > 0 THEN 'Generic/unhelpful response' END, CASE WHEN len(p) > 2 AND len(list_distinct(list_transform(p, lambda x: lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))))) / len(p)::DOUBLE < 0.7 THEN 'Repetitive content' END, CASE WHEN NOT regexp_matches(regexp_replace(t, '\\s+$', ''), '[.!?]$') AND regexp_matches(t, '\\S') THEN 'Incomplete sentence' END] AS x FROM s) SELECT doc_id, " + joined("list_filter(x, lambda i: i IS NOT NULL)") + " AS issues FROM q")
def quality_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.array_join(sc.quality_issues(F.col("text")), ", ").alias("issues"))


_W = "list_distinct(string_split(lower({}), ' '))"
_SIM = "len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE"


@query("response_similarity_selfjoin", f"""WITH a AS (SELECT event_id AS id, event_type AS topic, epoch_us(ts) AS micros, 'status of user ' || CAST(user_id % 3 AS VARCHAR) AS prompt, 'value ' || CAST(CAST(round(value) AS BIGINT) AS VARCHAR) || ' k' || CAST(event_id % 7 AS VARCHAR) AS answer FROM events),
p AS (SELECT x.id AS a, y.id AS b, x.topic, {_SIM.format(a=_W.format('x.prompt'), b=_W.format('y.prompt'))} AS prompt_similarity, {_SIM.format(a=_W.format('x.answer'), b=_W.format('y.answer'))} AS answer_similarity
FROM a x JOIN a y ON x.topic = y.topic AND y.micros BETWEEN x.micros AND x.micros + 600000000 AND (x.micros < y.micros OR x.id < y.id))
SELECT a, b, topic, round(prompt_similarity, 9) AS prompt_similarity, round(answer_similarity, 9) AS answer_similarity FROM p WHERE prompt_similarity > 0.8 AND answer_similarity < 0.3""")
def response_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    answer = F.concat(F.lit("value "), F.round("value").cast("bigint").cast("string"), F.lit(" k"), (F.col("event_id") % 7).cast("string"))
    rows = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("topic"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.concat(F.lit("status of user "), (F.col("user_id") % 3).cast("string")).alias("prompt"), answer.alias("answer"))
    out = sc.inconsistent_pairs(rows, 600)
    ninth = lambda c: (F.floor(F.col(c) * 1e9 + 0.5) / 1e9).alias(c)  # noqa: E731  round() makes decimal text of each value
    return out.select("a", "b", "topic", ninth("prompt_similarity"), ninth("answer_similarity"))


@query("browsing_policy", f"SELECT page_id, {joined('list_filter(x, lambda i: i IS NOT NULL)')} AS issues FROM (SELECT page_id, [CASE WHEN h = '' THEN 'invalid' END, CASE WHEN NOT (h = 'example.com' OR ends_with(h, '.example.com')) THEN 'domain' END] AS x FROM (SELECT page_id, lower({HOST_SQL}) AS h FROM (SELECT page_id, url AS u FROM pages)))")
def browsing_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(sc.url_issues(F.col("url"), ["example.com"]), ", ").alias("issues"))


@query("sql_safety", f"WITH d AS ({PLANTED_SQL}) SELECT doc_id, regexp_matches(t, '(?i)\\b(drop|truncate|alter|grant|revoke)\\b') AS dangerous, regexp_matches(t, '(?i)\\bselect\\b') AND NOT regexp_matches(t, '(?i)\\blimit\\b') AS unlimited FROM d")
def sql_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = sc.sql_issues(F.col("t"), ["users"])
    return planted(spark, sf_dir).select("doc_id", F.array_contains(issues, "dangerous operation").alias("dangerous"), F.array_contains(issues, "missing limit").alias("unlimited"))


#: Statements made of an order's columns, some with strings and comments that only look like SQL.
STATEMENTS = [
    "SELECT o_totalprice FROM orders WHERE o_orderkey = {k} LIMIT 1", "DELETE FROM orders WHERE o_orderkey = {k}", "DELETE FROM orders -- WHERE o_orderkey = {k}", "SELECT '{p}; DROP TABLE orders' FROM orders LIMIT {k}",
    "UPDATE orders SET o_orderstatus = 'WHERE {s}'", "SELECT a FROM orders, secrets_{k} WHERE b = {k}", "select a from orders where o_orderkey = {k} or 1 = 1 limit 3", "/* UPDATE orders SET a = {k} */ SELECT 1",
    "INSERT INTO audit VALUES ({k}, '{p}'); TRUNCATE TABLE audit", "SELECT MAX(a) FROM lineitem JOIN `part` ON b = c WHERE d = '{s}' FETCH FIRST {k} ROWS ONLY",
]


def _statement_sql() -> str:
    return "[" + ", ".join(f"replace(replace(replace({quoted(t)}, '{{k}}', CAST(o_orderkey AS VARCHAR)), '{{p}}', o_orderpriority), '{{s}}', o_orderstatus)" for t in STATEMENTS) + f"][CAST(o_orderkey % {len(STATEMENTS)} + 1 AS INTEGER)]"


def _one_of(sequences: list[str]) -> str:
    return " OR ".join(f"regexp_matches(x, {quoted(f' (?:{s}) ')})" for s in sequences)


_SKELETON = f"""SELECT o_orderkey, t, ' ' || array_to_string(list_transform(list_filter(regexp_extract_all(t, {quoted(sql_policy.TOKEN)}), lambda y: NOT regexp_matches(y, '{sql_policy.COMMENT}')),
  lambda y: CASE WHEN y[1] = '''' THEN '''s''' WHEN y[1] IN ('"', '`') THEN regexp_replace(upper(regexp_replace(y, '["`]', '', 'g')), '[ \\t\\n;]+', '_', 'g') ELSE upper(y) END), ' ') || ' ' AS x FROM (SELECT o_orderkey, {_statement_sql()} AS t FROM orders)"""
_OPEN = "len(list_filter(list_filter(string_split(x, ' ; '), lambda y: trim(y) <> ''), lambda y: {test})) > 0"
_UNGUARDED = _OPEN.format(test="regexp_matches(' ' || y || ' ', ' (?:DELETE FROM|UPDATE [^ ]+ SET) ') AND NOT contains(' ' || y || ' ', ' WHERE ')")
_UNLIMITED = _OPEN.format(test="regexp_matches(' ' || y || ' ', ' SELECT .* FROM ') AND NOT regexp_matches(' ' || y || ' ', ' (?:LIMIT|TOP|FETCH FIRST|FETCH NEXT) [0-9]')")


@query("sql_policy", f"""WITH k AS ({_SKELETON}), r AS (SELECT o_orderkey, ({_one_of(sql_policy.DANGEROUS)} OR ({_UNGUARDED} AND contains(x, ' DELETE FROM '))) AS danger, ({_one_of(sql_policy.HIGH_RISK)}) AS high, {_UNGUARDED} AS unguarded, {_UNLIMITED} AS unlimited,
  len(list_filter(string_split(x, ' ; '), lambda y: trim(y) <> '')) AS statements, regexp_matches(x, ' (?:OR|AND) 1 = 1 ') AS tautology, regexp_matches(x, ' SECRETS_[0-9]+ ') AS barred, regexp_matches(x, ' (?:LINEITEM|PART|SECRETS_[0-9]+) ') AS other FROM k)
SELECT o_orderkey, CASE WHEN danger OR tautology OR statements > 1 THEN 'critical' WHEN high OR unguarded OR unlimited OR other THEN 'high' ELSE 'low' END AS risk, array_to_string(list_filter([CASE WHEN unguarded THEN 'WHERE clause' END, CASE WHEN unlimited THEN 'LIMIT clause' END], lambda z: z IS NOT NULL), ', ') AS missing,
  statements::INT AS statements, barred FROM r""")
def sql_policy_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, STATEMENTS)), (F.col("o_orderkey") % len(STATEMENTS) + 1).cast("int"))
    for mark, column in (("{k}", "o_orderkey"), ("{p}", "o_orderpriority"), ("{s}", "o_orderstatus")):
        text = F.replace(text, F.lit(mark), F.col(column).cast("string"))
    out = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")).withColumn("r", sql_policy.analysed(F.col("t")))
    return out.select("o_orderkey", "r.risk", F.array_join("r.missing", ", ").alias("missing"), "r.statements", (F.size("r.blocked_tables") > 0).alias("barred"))


RETAINED = {"pii": "anonymize", "financial": "anonymize", "auth": "remove", "business": "anonymize", "medical": "remove"}


def _retention_sql() -> str:
    kinds = [(f"{c}_{t}", c, rx) for c, types in retention.SENSITIVE.items() for t, rx in types.items()]
    steps = [f"s0 AS (SELECT doc_id, t, t AS x FROM ({PLANTED_SQL}))"]
    for k, (name, c, rx) in enumerate(kinds):
        by = "[REMOVED]" if RETAINED[c] == "remove" else f"[{name.upper()}_REDACTED]"
        steps.append(f"s{k + 1} AS (SELECT doc_id, t, CASE WHEN {rx.sql()} THEN regexp_replace(x, {quoted(rx.re2)}, '{by}', 'g') ELSE x END AS x FROM s{k})")
    types = ", ".join(f"CASE WHEN {rx.sql()} THEN '{name}' END" for name, _, rx in kinds)
    counts = ", ".join("(" + " + ".join(rx.sql_count() for _, d, rx in kinds if d == c) + f")::INT AS {c}" for c in retention.SENSITIVE)
    days = "coalesce(least(" + ", ".join(f"CASE WHEN len(list_filter(types, lambda y: starts_with(y, '{c}_'))) > 0 THEN {n} END" for c, n in retention.DAYS.items()) + f"), {retention.CONVERSATION_DAYS})"
    return f"WITH {', '.join(steps)}, r AS (SELECT doc_id, md5(x) AS redacted, list_filter([{types}], lambda y: y IS NOT NULL) AS types, {counts} FROM s{len(kinds)}) SELECT * EXCLUDE (types), array_to_string(types, ',') AS types, CAST(DATE '2024-01-01' + {days}::INT AS DATE) AS expires_on FROM r"


@query("retention", _retention_sql())
def retention_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retention.redact(planted(spark, sf_dir), "t", RETAINED)
    return out.select("doc_id", F.md5("redacted").alias("redacted"), "counts.*", F.array_join("types", ",").alias("types"), retention.expires_on(F.lit("2024-01-01"), F.col("types")).alias("expires_on"))


_ANSWERS = "SELECT doc_id AS id, lang, text || '. The garden has ' || (doc_id % 4) || ' trees. It opened in ' || (1990 + doc_id % 2) || ' or so. The gate is' || CASE WHEN doc_id % 5 = 0 THEN ' not' ELSE '' END || ' open.' AS answer FROM documents"
_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query("contradictions", f"""WITH a AS ({_ANSWERS}), s AS (SELECT id, lang, answer, regexp_extract_all(answer, '[^.!?]*[.!?]') AS s FROM a),
f AS (SELECT DISTINCT id, lang, unnest(list_concat(list_transform(regexp_extract_all(answer, '[0-9]+\\.\\s+([^.!?]+[.!?])', 1), lambda x: {_TRIM.format('x')}),
  list_transform(s, lambda x: {_TRIM.format(f"regexp_extract(x, {quoted(facts.VERB.source)})")}), list_transform(s, lambda x: {_TRIM.format(f"regexp_extract(x, {quoted(facts.DATA.source)})")}))) AS f FROM s),
k AS (SELECT id, lang, 'number' AS kind, regexp_replace(f, '[0-9]+', 'X', 'g') AS frame, regexp_extract(f, '[0-9]+') AS value FROM f WHERE regexp_matches(f, '[0-9]')
  UNION SELECT id, lang, 'date', regexp_replace(f, {quoted(facts.YEAR.source)}, 'YEAR', 'g'), regexp_extract(f, {quoted(facts.YEAR.source)}) FROM f WHERE regexp_matches(f, {quoted(facts.YEAR.source)})
  UNION SELECT id, lang, 'opposite', lower({_TRIM.format("regexp_replace(regexp_replace(f, '\\bnot\\b', '', 'g'), '\\s+', ' ', 'g')")}), CAST(contains(f, 'not') AS VARCHAR) FROM f WHERE f <> ''),
v AS (SELECT lang, kind, frame, value, count(*) AS answers, min(id) AS first_id FROM k WHERE frame <> '' GROUP BY ALL)
SELECT v.lang, v.kind, md5(v.frame) AS frame, v.value, v.answers, v.first_id, n AS values FROM v JOIN (SELECT lang, kind, frame, count(*) AS n FROM v GROUP BY ALL HAVING count(*) > 1) AS w ON w.lang IS NOT DISTINCT FROM v.lang AND w.kind = v.kind AND w.frame = v.frame""")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in one language that differ in a number, a year or a negation; every document ends with three facts of its own."""
    i = F.col("doc_id")
    more = F.concat(F.lit(". The garden has "), (i % 4).cast("string"), F.lit(" trees. It opened in "), (1990 + i % 2).cast("string"), F.lit(" or so. The gate is"), F.when(i % 5 == 0, " not").otherwise(""), F.lit(" open."))
    answers = table(spark, sf_dir, "documents").select(i.alias("id"), "lang", F.concat("text", more).alias("answer"))
    out = facts.conflicts(facts.stated(answers, "lang"), "lang")
    return out.withColumn("frame", F.md5("frame"))


_KEPT = "t"
for _kind, _rx in input_checks.PII.items():
    _KEPT = f"regexp_replace({_KEPT}, {quoted(_rx.re2)}, '[{_kind.upper()}]', 'g')"


@query("retained_text", f"SELECT doc_id, md5({_KEPT}) AS retained FROM ({PLANTED_SQL})")
def retained_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).select("doc_id", F.md5(sc.retained(F.col("t"))).alias("retained"))


@query("review_queue", "SELECT event_type AS category, count(*) FILTER (value > 50) AS pending, count(*) FILTER (NOT value > 50) AS done, min(epoch_us(ts)) AS oldest FROM events GROUP BY event_type")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return sc.review_queue(e.select(F.col("event_type").alias("category"), F.when(F.col("value") > 50, "pending").otherwise("done").alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros")))


@query("escalation_rate", f"WITH d AS ({PLANTED_SQL}) SELECT doc_id, round(len(regexp_extract_all(t, {quoted(Rx('kill|stupid|hate', 'i').re2)})) / greatest(length(t), 1)::DOUBLE * 100, 9) AS rate FROM d")
def escalation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).select("doc_id", F.round(sc.escalation_rate(F.col("t"), [Rx("kill|stupid|hate", "i")]), 9).alias("rate"))
