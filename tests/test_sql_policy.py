"""SQL judged on tokens, against a lexer that goes character by character."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from bulwark.operators import sql_policy as sq
from bulwark.operators.check import Scope


def lex(text):
    """Tokens by hand."""
    out, i, n = [], 0, len(text)
    word = lambda c: c.isascii() and (c.isalnum() or c in "_$")
    first = lambda c: c.isascii() and (c.isalpha() or c == "_")
    while i < n:
        c = text[i]
        j = i + 1
        if c in " \t\n\r\f\x0b":
            i += 1
            continue
        if c in "'\"`":
            while j < n and text[j] != c:
                j += 1
            j = min(n, j + 1)
        elif text.startswith("--", i) or c == "#":
            while j < n and text[j] != "\n":
                j += 1
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            j = n if end < 0 else end + 2
        elif first(c):
            while j < n and word(text[j]):
                j += 1
            while j + 1 < n and text[j] == "." and (first(text[j + 1]) or text[j + 1] == "*"):
                j += 2
                while j < n and word(text[j]):
                    j += 1
        elif c.isdigit() and c.isascii():
            while j < n and text[j].isdigit():
                j += 1
            if j + 1 < n and text[j] == "." and text[j + 1].isdigit():
                j += 2
                while j < n and text[j].isdigit():
                    j += 1
        elif text[i : i + 2] in ("<>", "<=", ">=", "!=", "||"):
            j = i + 2
        out.append(text[i:j])
        i = j
    return out


BITS = [
    "SELECT", "a", "*", "FROM", "users", "secrets_x", ",", "DELETE", "WHERE", "id", "=", "1", "'DROP TABLE x'", "'it''s", "-- DROP\n", "/* x", "*/", ";", "(", ")", "\"Od d\"", "`t`", "DROP", "TABLE", "LIMIT", "5", "OR", "1.5", "||", "#c\n", "-", "é", "\n", "sys.tables", "x.*", "UPDATE", "SET", "<=",
]


def test_lexer(spark):
    rng = random.Random(1)
    texts = [rng.choice([" ", "", "  "]).join(rng.choices(BITS, k=rng.randint(0, 14))) for _ in range(600)]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(4).orderBy("k").select(sq.tokens(F.col("t"))).collect()]
    for text, tokens in zip(texts, got, strict=True):
        assert tokens == lex(text), text


def analysed(spark, sql, **options):
    return spark.createDataFrame([(sql,)], "t string").select(sq.analysed(F.col("t"), **options).alias("r")).first().r


@pytest.mark.parametrize(
    ("sql", "risk", "violations"),
    [
        ("SELECT name FROM users WHERE id = 4 LIMIT 10", "low", []),
        ("SELECT name FROM users WHERE note = 'DROP TABLE users; DELETE FROM users' LIMIT 10 -- TRUNCATE TABLE users", "low", []),
        ("select name from users limit 10 /* update users set a = 1 */", "low", []),
        ("DELETE FROM users", "critical", ["operations: DELETE without WHERE", "missing: WHERE clause"]),
        ("DELETE FROM users WHERE id = 1", "low", []),
        ("DELETE FROM users; SELECT a FROM users WHERE a = 1 LIMIT 1", "critical", ["operations: DELETE without WHERE", "missing: WHERE clause", "injection: stacked statements"]),
        ("UPDATE users SET a = 'WHERE'", "high", ["operations: UPDATE USERS SET", "missing: WHERE clause"]),
        ("drop\n  table users", "critical", ["operations: DROP TABLE"]),
        ("SELECT a FROM users, secrets_all s, `orders` WHERE a = 2", "high", ["missing: LIMIT clause", "blocked tables: secrets_all"]),
        ("SELECT a FROM users JOIN weather ON x = y FETCH FIRST 5 ROWS ONLY", "high", ["unknown tables: weather"]),
        ("SELECT a FROM users WHERE id = 3 OR 1 = 1 LIMIT 2", "critical", ["injection: tautology"]),
        ("SELECT a FROM users WHERE id = 3 OR 1 = 2 LIMIT 2", "low", []),
        ("EXEC ('x' + 'y')", "critical", [r"operations: EXEC (", "injection: dynamic SQL, string concatenation"]),
        ("SELECT a FROM users WHERE n = 'open LIMIT 5", "critical", ["missing: LIMIT clause", "injection: unterminated string or comment"]),
        ("SELECT a FROM users /* open LIMIT 5", "critical", ["missing: LIMIT clause", "injection: unterminated string or comment"]),
        ("GRANT ALL ON users TO bob", "critical", ["operations: GRANT ALL ON USERS TO"]),
        ("", "low", []), (None, "low", []), ("What a lovely quiet evening in the garden", "low", []),
    ],
)
def test_policy(spark, sql, risk, violations):
    r = analysed(spark, sql)
    assert (r.risk, r.violations) == (risk, violations)


def test_complexity(spark):
    calls = ", ".join(f"MAX(a{k})" for k in range(25))
    r = analysed(spark, f"SELECT {calls} FROM users, " + ", ".join(f"orders{k}" for k in range(12)) + " WHERE ((((((a = 1)))))) LIMIT 3")
    assert (r.calls, r.depth, r.complexity, r.risk, len(r.tables)) == (25, 6, "high", "medium", 13)
    assert analysed(spark, "SELECT 1 -- " + "x" * 600).comment_length == 603


def test_long_texts_and_allowlists(spark):
    long = "SELECT a FROM users WHERE b = 'x' AND c IN (" + ", ".join(["''''"] * 30_000) + ") LIMIT 5"
    assert analysed(spark, long).violations == []
    assert analysed(spark, "SELECT a FROM t LIMIT 1", allowed=["t"]).violations == [] and analysed(spark, "SELECT a FROM t LIMIT 1", allowed=[], blocked=[]).unknown_tables == ["t"]
    r = spark.createDataFrame([("TRUNCATE TABLE users",)], "t string").select(sq.sql_policy()(Scope(F.col("t"))).alias("r")).first().r
    assert (r.triggered, r.severity, r.message) == (True, "critical", "Unsafe SQL: operations: TRUNCATE TABLE")
