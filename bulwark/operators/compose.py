"""Algebra over results: each function takes result structs and returns one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from bulwark.functions.result import RESULT, highest, let, passed, rank, result, with_fields

EMPTY = f"array<{RESULT}>"


def results(*each: Column) -> Column:
    return F.array(*each).cast(EMPTY)


def when(condition: Column, check: Column, name: str = "conditional") -> Column:
    """The check where the condition holds, else a pass that says so."""
    return F.when(F.coalesce(condition, F.lit(False)), check).otherwise(with_fields(passed(name), message=F.lit("Condition not met, skipped")))


def after(first: Column, then: Column) -> Column:
    """The first check's result if it triggers, else the second's."""
    return F.when(first["triggered"], first).otherwise(then)


def with_fallback(primary: Column, fallback: Column) -> Column:
    """The fallback where the primary failed."""
    return F.when(primary["execution_failed"], fallback).otherwise(primary)


def negated(check: Column, message: str = "Negated check did not trigger") -> Column:
    """Triggered and passed exchanged."""
    return let(check, lambda r: with_fields(r, triggered=~r["triggered"], message=F.when(~r["triggered"], F.lit(message))))


def triggered_of(every: Column) -> Column:
    """Triggered results, a failed member counting as triggered and of high severity."""
    counted = F.transform(every, lambda r: F.when(r["execution_failed"], r.withField("triggered", F.lit(True)).withField("severity", F.lit("high"))).otherwise(r))
    return F.filter(counted, lambda r: r["triggered"])


def parallel(*checks: Column, mode: str = "any", name: str = "parallel") -> Column:
    """``any``: the first that triggers, with all messages; ``all``: only if every one does (an empty list does)."""

    def judged(bad: Column) -> Column:
        messages = F.array_join(F.transform(bad, lambda r: r["message"]), "; ")
        if mode == "all":
            return result(name, F.size(bad) == len(checks), F.coalesce(highest(F.transform(bad, lambda r: r["severity"])), F.lit("medium")), messages)
        return result(name, F.size(bad) > 0, F.coalesce(F.get(bad, F.lit(0))["severity"], F.lit("medium")), messages, first=F.get(bad, F.lit(0))["guardrail_name"])

    return let(triggered_of(results(*checks)), judged)


def pipeline(*checks: Column, short_circuit: bool = True, name: str = "pipeline") -> Column:
    """The first triggered result with its stage; without short circuit it never triggers."""
    if not short_circuit:
        return passed(name, stages=len(checks))
    stage = lambda k: F.create_map(F.lit("stage"), k.cast("string"))
    staged = F.transform(results(*checks), lambda r, k: r.withField("metadata", F.map_concat(r["metadata"], stage(k)).cast("map<string,string>")))
    return F.coalesce(F.get(F.filter(staged, lambda r: r["triggered"]), F.lit(0)), passed(name, stages=len(checks)))


def with_retry(attempt: Callable[[int], Column], max_retries: int = 3) -> Column:
    """The first attempt that did not fail, else the last one.

    ``attempt(k)`` builds the ``k``-th attempt, such as a call of a model; it runs only for rows whose earlier attempts failed.
    """
    out = attempt(max_retries)
    for k in reversed(range(max_retries)):
        out = let(attempt(k), lambda r, rest=out: F.when(r["execution_failed"], rest).otherwise(r))
    return out


def compare_severity(a: Column, b: Column) -> Column:
    return rank(a) - rank(b)
