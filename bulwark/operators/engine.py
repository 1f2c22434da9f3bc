"""Running lists of checks over a DataFrame, in one narrow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.errors import InputBlocked, OutputBlocked
from bulwark.functions.result import let, rank
from bulwark.operators.check import Check, Scope, prepared
from bulwark.operators.compose import EMPTY


def run(checks: list[Check], scope: Scope, sequential: bool = False) -> Column:
    """Array of results, in order of priority; ``sequential`` stops after the first that triggers."""
    every = F.array(*[c(scope) for c in prepared(checks)]).cast(EMPTY)
    if not sequential:
        return every
    return upto_first(every)


def upto_first(every: Column) -> Column:
    """Results up to and with the first that triggered."""
    state = F.struct(F.lit(False).alias("stop"), F.array().cast(EMPTY).alias("out"))
    return F.aggregate(
        every, state,
        lambda a, r: F.when(a["stop"], a).otherwise(F.struct(r["triggered"].alias("stop"), F.concat(a["out"], F.array(r)).alias("out"))), lambda a: a["out"],
    )


def summary(results: Column) -> Column:
    """``executed, passed, blocked, failed`` and the ``blocked_results`` of one record; failed are critical and triggered."""
    bad = F.filter(results, lambda r: r["triggered"])
    return F.struct(
        F.size(results).alias("executed"), (F.size(results) - F.size(bad)).alias("passed"), F.size(bad).alias("blocked"),
        F.size(F.filter(bad, lambda r: r["severity"] == "critical")).alias("failed"), bad.alias("blocked_results"),
    )


def selected(summary: Column, which: str = "first") -> Column:
    """Blocked results: the ``first``, ``all``, or the one of ``highest-severity`` (the first of equals)."""
    bad = summary["blocked_results"]
    if which == "all":
        return bad
    if which == "first":
        return F.slice(bad, 1, 1)
    best = F.array_max(F.transform(bad, lambda r, i: F.struct(rank(r["severity"]).alias("rank"), (-i).alias("i"))))
    return F.when(F.size(bad) == 0, bad).otherwise(F.slice(bad, 1 - best["i"], F.lit(1)))


def blocked_text(summary: Column, phase: str = "Output") -> Column:
    """What replaces a blocked text."""
    messages = F.transform(summary["blocked_results"], lambda r: F.coalesce(r["message"], F.lit("blocked")))
    return F.concat(F.lit(f"[{phase} blocked: "), F.array_join(messages, ", "), F.lit("]"))


def guard(
    df: DataFrame, text: str, input_checks: list[Check] = (), output_checks: list[Check] = (), sequential: bool = False, replace: bool = True, on_block: str = "mark", **columns: Column,
) -> DataFrame:
    """``df`` with ``results``, ``summary``, ``blocked`` and ``final_text``.

    ``on_block`` ``raise`` ends with an error if any record is blocked; ``mark`` leaves that to the reader.
    """
    phase = "Output" if output_checks else "Input"
    scope = Scope(F.coalesce(F.col(text), F.lit("")), **columns)

    def decided(results: Column) -> Column:
        return let(summary(results), lambda s: F.struct(results.alias("results"), s.alias("summary"), (s["blocked"] > 0).alias("blocked"), F.when(s["blocked"] > 0, blocked_text(s, phase)).alias("notice")))

    # one bound value: the optimizer would otherwise copy every check into each column that reads the results
    out = df.withColumn("__guarded", let(run([*input_checks, *output_checks], scope, sequential), decided))
    final = F.coalesce(F.col("__guarded.notice"), F.col(text)) if replace else F.col(text)
    out = out.withColumns({"results": F.col("__guarded.results"), "summary": F.col("__guarded.summary"), "blocked": F.col("__guarded.blocked"), "final_text": final}).drop("__guarded")
    if on_block == "raise" and not out.filter("blocked").isEmpty():
        raise (OutputBlocked if output_checks else InputBlocked)("blocked records")
    return out


def long_results(df: DataFrame, key: str) -> DataFrame:
    """One row for each record and result: the trace table."""
    return df.select(key, F.posexplode("results").alias("position", "r")).select(key, "position", "r.*")


def finish_reason(summary: Column) -> Column:
    return F.when(summary["blocked"] > 0, "content_filter").otherwise("stop")


def provider_metadata(summary: Column) -> Column:
    """Violations as a response's metadata would carry them."""
    violations = F.transform(summary["blocked_results"], lambda r: F.struct(r["guardrail_name"].alias("guardrail"), r["severity"].alias("severity"), r["message"].alias("message")))
    return F.struct((summary["blocked"] > 0).alias("blocked"), violations.alias("violations"))


def retry_instruction(summary: Column) -> Column:
    """The blocked results' suggestions as one instruction, numbered if several."""
    said = F.transform(summary["blocked_results"], lambda r: F.coalesce(r["suggestion"], r["message"], F.lit("")))
    numbered = F.array_join(F.transform(said, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    return F.when(F.size(said) == 1, F.get(said, F.lit(0))).otherwise(numbered)


def retry_temperature(deltas: Column, last: Column | None = None) -> Column:
    """Temperature of the next attempt: the last (0.7) moved by the mean delta, within 0 and 1."""
    mean = F.when(F.size(deltas) > 0, F.aggregate(deltas, F.lit(0.0), lambda a, x: a + x) / F.size(deltas)).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.lit(0.7) if last is None else last, F.lit(0.7)) + mean))


def resolved_retries(global_retries: int, own: Column) -> Column:
    """The global number unless zero, else the largest that a blocked check asks for."""
    return F.lit(global_retries) if global_retries else F.coalesce(F.array_max(own), F.lit(0))


def increased_tokens(last: Column, by: int = 200) -> Column:
    """Output tokens of a retry, 400 at least."""
    return F.greatest(F.lit(400), F.coalesce(last, F.lit(400)) + by)
