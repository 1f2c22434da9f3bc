"""Safety of generated SQL, judged on its tokens.

A lexer, one pattern matched from left to right, cuts a text into tokens: strings, quoted names, comments, words, numbers and
signs.  Whatever stands inside a string or a comment is one token and can no longer look like SQL.  What is left is written
as a *skeleton*, words in upper case and one space between tokens, and split into statements; rules are sequences of words in it.
So ``'DROP TABLE x'`` in quotes drops nothing, and a ``WHERE`` in a subquery's neighbour statement excuses no ``DELETE``.

Everything is a Column expression: one scan, no shuffle, time in proportion to the text.  A string or comment that is never closed reaches to
the end.  Null texts are empty, and empty texts are safe; tables of a comma list count, names are compared in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bulwark.functions.result import SEVERITIES, let, result
from bulwark.operators.check import Check, Scope

#: Strings, quoted names, comments to the line's end, comments, words, numbers, signs.
TOKEN = r"""'[^']*'?|"[^"]*"?|`[^`]*`?|--[^\n]*|#[^\n]*|/\*(?s:.*?)(?:\*/|\z)|[A-Za-z_][A-Za-z0-9_$]*(?:\.[A-Za-z_*][A-Za-z0-9_$]*)*|[0-9]+(?:\.[0-9]+)?|<>|<=|>=|!=|\|\||[^ \t\n\r\f\x0B]"""
COMMENT = r"^(--|#|/\*)"
#: Operations that are dangerous, and those that carry a high risk, as sequences of words.
DANGEROUS = [
    "DROP (?:TABLE|DATABASE|SCHEMA|INDEX|VIEW|TRIGGER|PROCEDURE|FUNCTION)", "TRUNCATE TABLE", "ALTER (?:TABLE|DATABASE|SCHEMA)", "CREATE (?:TABLE|DATABASE|SCHEMA|INDEX|VIEW|TRIGGER|PROCEDURE|FUNCTION)",
    "GRANT (?:[^ ]+ )+TO", "REVOKE (?:[^ ]+ )+FROM", r"EXEC \(", r"EXECUTE \(", "SP_EXECUTESQL", "XP_CMDSHELL", "BACKUP DATABASE", "RESTORE DATABASE", "BULK INSERT", "OPENROWSET", "OPENDATASOURCE", "OPENQUERY",
]
HIGH_RISK = ["UPDATE [^ ]+ SET", "INSERT INTO", "MERGE INTO", "UPSERT", "REPLACE INTO", "LOAD DATA", "COPY FROM", "UNION", "CROSS JOIN", "OUTER JOIN"]
#: Parts of names of tables that are allowed, and of tables that never are.
ALLOWED = ["users", "products", "orders", "customers", "inventory", "sales", "reports", "analytics", "logs", "audit"]
BLOCKED = [
    "system.", "sys.", "information_schema.", "performance_schema.", "mysql.", "pg_", "sqlite_", "temp_", "tmp_", "backup_", "archive_", "admin_", "root_", "master_", "config_", "settings_", "secrets_", "passwords_", "tokens_", "keys_",
]
#: From which length, number of tables, of calls, length of comments and depth on a statement counts as complex.
LIMITS = {"length": 10_000, "tables": 10, "calls": 20, "comments": 500, "depth": 5}
#: Words that end a list of tables.
CLAUSES = [
    "SELECT", "FROM", "WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "FETCH", "UNION", "INTERSECT", "EXCEPT", "ON", "USING", "SET", "VALUES", "JOIN", "LEFT", "RIGHT", "INNER", "OUTER", "FULL", "CROSS", "NATURAL", "UPDATE", "INTO",
    "DELETE", "INSERT", "RETURNING", "WINDOW", "(", ")", ";",
]

#: Words that a parenthesis may follow without a call.
NO_CALLS = ["WHERE", "AND", "OR", "NOT", "IN", "EXISTS", "ON", "AS", "BY", "ANY", "ALL", "FROM", "JOIN", "SELECT", "VALUES", "SET", "HAVING", "LIMIT", "USING", "UNION", "EXEC", "EXECUTE"]


def tokens(sql: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(sql, F.lit("")), F.lit(TOKEN), F.lit(0))


def skeleton(found: Column) -> Column:
    """Tokens less comments, between single spaces: words and quoted names in upper case, every string as ``'s'``."""
    plain = F.transform(
        F.filter(found, lambda t: ~t.rlike(COMMENT)),
        lambda t: F.when(F.startswith(t, F.lit("'")), F.lit("'s'")).when(t.rlike('^["`]'), F.regexp_replace(F.upper(F.regexp_replace(t, '["`]', "")), r"[ \t\n\r\f\x0B;]+", "_")).otherwise(F.upper(t)),
    )
    return F.concat(F.lit(" "), F.array_join(plain, " "), F.lit(" "))


def _any(text: Column, sequences: list[str]) -> Column:
    """Which sequences of words occur, as they stand."""
    each = F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit(f" {s}(?= )"), F.lit(0)), lambda m: F.trim(m)) for s in sequences]))
    return F.when(text.rlike(f" (?:{'|'.join(sequences)}) "), each).otherwise(F.array().cast("array<string>"))


def statements(text: Column) -> Column:
    return F.filter(F.split(text, " ; "), lambda s: F.trim(s) != "")


def tables(text: Column) -> Column:
    """Names after FROM, JOIN, UPDATE and INTO, those of a comma list included, in lower case and each once."""
    marked = F.array_join(F.transform(F.split(F.trim(text), " "), lambda w: F.when(w.isin(CLAUSES), F.concat(F.lit("|"), w)).otherwise(w)), " ")
    lists = F.regexp_extract_all(marked, F.lit(r"\|(?:FROM|JOIN|UPDATE|INTO) ([^|]*)"), F.lit(1))
    first = F.flatten(F.transform(lists, lambda r: F.transform(F.split(r, " , "), lambda piece: F.element_at(F.split(F.trim(piece), " "), 1))))
    return F.array_distinct(F.transform(F.filter(first, lambda w: w.rlike("^[A-Z_]")), F.lower))


def depth(text: Column) -> Column:
    """How deep parentheses nest."""
    signs = F.split(F.regexp_replace(text, r"[^()]", ""), "")
    return F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, c: let(
        a["now"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0), lambda n: F.struct(n.alias("now"), F.greatest(a["most"], n).alias("most")),
    ), lambda a: a["most"])


def analysed(sql: Column, allowed: list[str] | None = None, blocked: list[str] | None = None) -> Column:
    """``risk``, ``violations``, ``operations``, ``tables``, ``blocked_tables``, ``unknown_tables``, ``missing``, ``injection``, ``statements``, ``complexity`` and its measures."""
    allowed, blocked = ALLOWED if allowed is None else allowed, BLOCKED if blocked is None else blocked
    part = lambda t, of: F.exists(F.array(*map(F.lit, of)), lambda p: F.contains(t, p)) if of else F.lit(False)

    # each step binds what the next reads more than once: an expression in a lambda is evaluated wherever it stands

    def measured(found: Column, text: Column) -> Column:
        each = statements(text)
        comments = F.aggregate(F.filter(found, lambda t: t.rlike(COMMENT)), F.lit(0), lambda a, t: a + F.length(t))
        calls = F.regexp_count(text, F.lit(r" [A-Z_][A-Z0-9_.$]* \(")) - F.regexp_count(text, F.lit(rf" (?:{'|'.join(NO_CALLS)}) \("))
        unterminated = F.exists(found, lambda t: t.rlike(r"^'[^']*$|^/\*(?s:.*)(?<!\*/)$"))
        return F.struct(
            text.alias("text"), each.alias("each"), _any(text, DANGEROUS).alias("danger"), _any(text, HIGH_RISK).alias("high"), tables(text).alias("named"), comments.alias("comments"), calls.alias("calls"), depth(text).alias("depth"),
            unterminated.alias("unterminated"), F.length(F.coalesce(sql, F.lit(""))).alias("length"),
        )

    def judged(m: Column) -> Column:
        unguarded = F.filter(m["each"], lambda s: s.rlike(r" (DELETE FROM|UPDATE [^ ]+ SET) ") & ~F.contains(s, F.lit(" WHERE ")))
        unlimited = F.exists(m["each"], lambda s: s.rlike(" SELECT .* FROM ") & ~s.rlike(r" (LIMIT|TOP|FETCH FIRST|FETCH NEXT) [0-9]"))
        same = F.regexp_extract_all(m["text"], F.lit(r" (?:OR|AND) ([^ ]+) = ([^ ]+)(?= )"), F.lit(0))
        tautology = F.exists(same, lambda t: let(F.split(F.trim(t), " "), lambda w: w[1] == w[3]))
        injection = F.filter(F.array(
            F.when(tautology, "tautology"), F.when(F.size(m["each"]) > 1, "stacked statements"), F.when(m["text"].rlike(r" (EXEC|EXECUTE|SP_EXECUTESQL) \( "), "dynamic SQL"),
            F.when(m["text"].rlike(r" 's' \+ 's' "), "string concatenation"), F.when(m["unterminated"], "unterminated string or comment"),
        ), lambda x: x.isNotNull())
        score = (
            F.when(m["length"] > LIMITS["length"], 3).otherwise(0) + F.when(F.size(m["named"]) > LIMITS["tables"], 2).otherwise(0) + F.when(m["calls"] > LIMITS["calls"], 2).otherwise(0)
            + F.when(m["comments"] > LIMITS["comments"], 1).otherwise(0) + F.when(m["depth"] > LIMITS["depth"], 2).otherwise(0)
        )
        return F.struct(
            m.alias("m"), F.size(unguarded).alias("unguarded"), unlimited.alias("unlimited"), injection.alias("injection"), score.alias("score"),
            F.concat(m["danger"], F.transform(F.filter(unguarded, lambda s: F.contains(s, F.lit(" DELETE FROM "))), lambda s: F.lit("DELETE without WHERE"))).alias("danger"),
            F.filter(m["named"], lambda t: ~part(t, allowed)).alias("others"),
        )

    def sorted_out(j: Column) -> Column:
        missing = F.filter(F.array(F.when(j["unguarded"] > 0, "WHERE clause"), F.when(j["unlimited"], "LIMIT clause")), lambda x: x.isNotNull())
        return F.struct(
            j.alias("j"), F.concat(j["danger"], j["m"]["high"]).alias("operations"), missing.alias("missing"), F.filter(j["others"], lambda t: part(t, blocked)).alias("barred"), F.filter(j["others"], lambda t: ~part(t, blocked)).alias("unknown"),
            F.when(j["score"] >= 5, "high").when(j["score"] >= 2, "medium").otherwise("low").alias("complexity"),
        )

    def report(r: Column) -> Column:
        j = r["j"]
        told = [("operations", r["operations"]), ("missing", r["missing"]), ("blocked tables", r["barred"]), ("unknown tables", r["unknown"]), ("injection", j["injection"])]
        violations = F.filter(F.array(*[F.when(F.size(of) > 0, F.concat(F.lit(f"{name}: "), F.array_join(of, ", "))) for name, of in told]), lambda x: x.isNotNull())
        high = (F.size(r["operations"]) > 0) | (F.size(r["missing"]) > 0) | (F.size(j["others"]) > 0)
        risk = F.when((F.size(j["danger"]) > 0) | (F.size(j["injection"]) > 0), "critical").when(high, "high").when(r["complexity"] == "high", "medium").otherwise("low")
        return F.struct(
            risk.alias("risk"), violations.alias("violations"), r["operations"].alias("operations"), j["m"]["named"].alias("tables"), r["barred"].alias("blocked_tables"), r["unknown"].alias("unknown_tables"), r["missing"].alias("missing"),
            j["injection"].alias("injection"), F.size(j["m"]["each"]).alias("statements"), r["complexity"].alias("complexity"), j["m"]["calls"].alias("calls"), j["m"]["comments"].alias("comment_length"), j["m"]["depth"].alias("depth"),
        )

    found = lambda found: let(skeleton(found), lambda text: measured(found, text))
    return let(let(let(let(tokens(sql), found), judged), sorted_out), report)


def sql_policy(allowed: list[str] | None = None, blocked: list[str] | None = None) -> Check:
    """Triggers on any violation, as severe as the risk."""

    def build(s: Scope) -> Column:
        return let(analysed(s.text, allowed, blocked), lambda a: result(
            "sql-policy", F.size(a["violations"]) > 0, a["risk"], F.concat(F.lit("Unsafe SQL: "), F.array_join(a["violations"], "; ")), risk=a["risk"], complexity=a["complexity"],
        ))

    return Check("sql-policy", build, SEVERITIES[3])
