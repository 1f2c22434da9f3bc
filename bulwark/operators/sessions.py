"""Operators over ordered rows of a session: window functions, and folds where the order is inherently sequential."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bulwark.functions.result import rank
from bulwark.operators.folds import Anchored, Bucket, Recent, folded


def so_far(key: list[str], order: list[str]):
    """Rows of a session up to the current one."""
    return W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


# Stop conditions: each is a boolean column over the violations of a session, one row each, in order.


def any_critical(key: list[str], order: list[str], severity: Column) -> Column:
    return F.max(severity == "critical").over(so_far(key, order))


def violation_count(key: list[str], order: list[str], least: int) -> Column:
    return F.count("*").over(so_far(key, order)) >= least


def severity_count(key: list[str], order: list[str], severity: Column, exactly: str, least: int = 1) -> Column:
    return F.count_if(severity == exactly).over(so_far(key, order)) >= least


def guardrail_count(key: list[str], order: list[str], name: Column, exactly: str, least: int = 1) -> Column:
    return F.count_if(name == exactly).over(so_far(key, order)) >= least


def consecutive(key: list[str], order: list[str], step: Column, n: int) -> Column:
    """Whether the last ``n`` violations stand on steps one apart."""
    if n <= 1:
        return F.lit(True)
    return F.coalesce(step - F.lag(step, n - 1).over(W.partitionBy(*key).orderBy(*order)) == n - 1, F.lit(False))


def stream_stop(key: list[str], order: list[str], severity: Column, least: int = 2) -> Column:
    """The default of streams: two violations, or a critical one (agents: three)."""
    return violation_count(key, order, least) | any_critical(key, order, severity)


def agent_stop(key: list[str], order: list[str], severity: Column) -> Column:
    return stream_stop(key, order, severity, 3)


def any_of(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def all_of(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


# Budgets and steps.


def budget(df: DataFrame, key: list[str], order: list[str], max_cost: float | None = None, max_tokens: int | None = None, max_calls: int | None = None) -> DataFrame:
    """Steps (``cost_usd, tokens, is_tool, is_error``) with running totals and ``stopped``, which stays once set."""
    w = so_far(key, order)
    out = df.withColumn("total_cost", F.sum("cost_usd").over(w)).withColumn("total_tokens", F.sum("tokens").over(w))
    out = out.withColumn("total_calls", F.count_if("is_tool").over(w)).withColumn("total_errors", F.count_if("is_error").over(w)).withColumn("total_steps", F.count("*").over(w))
    over = any_of(*([F.col("total_cost") > max_cost] if max_cost is not None else []), *([F.col("total_tokens") > max_tokens] if max_tokens is not None else []), *([F.col("total_calls") > max_calls] if max_calls is not None else []))
    return out.withColumn("over", over).withColumn("stopped", F.max("over").over(w)).drop("over")


def plan_so_far(df: DataFrame, key: list[str], order: list[str], tools: str) -> DataFrame:
    """Tool names of all steps up to each one, blank names left out."""
    names = F.flatten(F.collect_list(tools).over(so_far(key, order)))
    return df.withColumn("plan", F.filter(names, lambda n: F.trim(n) != ""))


def prepare_step(df: DataFrame, key: list[str], step: str, violations: str, critical: str, lookback: int = 2, reduction: float = 0.3, base: float = 0.7) -> DataFrame:
    """Recent violations before each step, the temperature they call for, and whether a critical one stops."""
    w = W.partitionBy(*key).orderBy(step).rangeBetween(-lookback, -1)
    out = df.withColumn("recent", F.coalesce(F.sum(violations).over(w), F.lit(0))).withColumn("stop", F.coalesce(F.max(critical).over(w), F.lit(False)))
    return out.withColumn("temperature", F.when(F.col("recent") > 0, F.greatest(F.lit(0.0), F.lit(base - reduction))).otherwise(F.lit(base)))


def adaptive_step(df: DataFrame, key: list[str], step: str, violations: str, lookback: int = 3, escalate_after: int = 5) -> DataFrame:
    """Temperature that falls with recent violations; stops after ``escalate_after``."""
    w = W.partitionBy(*key).orderBy(step).rangeBetween(-lookback, -1)
    out = df.withColumn("recent", F.coalesce(F.sum(violations).over(w), F.lit(0)))
    return out.withColumn("temperature", F.greatest(F.lit(0.1), F.lit(0.7) - F.lit(0.15) * F.col("recent"))).withColumn("stop", F.col("recent") >= escalate_after)


def sliding_count(key: list[str], micros: Column, seconds: float) -> Column:
    """Events of the last ``seconds``, the current one included."""
    return F.count("*").over(W.partitionBy(*key).orderBy(micros).rangeBetween(-int(seconds * 1_000_000), 0))


# Folds: windows anchored at their first event have no window function, nor have buckets (see ``folds``).


def anchored_counts(df: DataFrame, key: str, micros: str, window_s: float, order: list[str] | None = None, inclusive: bool = False, limit: int | None = None) -> DataFrame:
    """``df`` with ``count`` and ``window_start`` per key: the kernel of rate limits and escalation.

    With a ``limit``, what is beyond it is denied and not counted: each such event's count is the limit and one.
    """
    out = folded(df, key, micros, Anchored(int(window_s * 1_000_000), inclusive), order)
    return out if limit is None else out.withColumn("count", F.least("count", F.lit(limit + 1).cast("long")))


def rate_limited(df: DataFrame, key: str, micros: str, limit: int, window_s: float = 60, order: list[str] | None = None) -> DataFrame:
    """Requests over a fixed window anchored at the first one; denied ones count. Adds ``limited`` and ``retry_ms``."""
    out = anchored_counts(df, key, micros, window_s, order)
    left = F.lit(int(window_s * 1000)) - F.floor((F.col(micros) - F.col("window_start")) / 1000)
    return out.withColumn("limited", F.col("count") > limit).withColumn("retry_ms", F.when(F.col("limited"), F.least(left + 1000, F.lit(30000))))


def strict_rate_limited(df: DataFrame, key: str, micros: str, limit: int, window_s: float = 60, order: list[str] | None = None) -> DataFrame:
    """The variant that restarts at the window's end and does not count denied requests."""
    return anchored_counts(df, key, micros, window_s, order, inclusive=True, limit=limit).withColumn("limited", F.col("count") > limit)


def escalated(df: DataFrame, key: str, micros: str, warn: int, block: int, window_s: float, order: list[str] | None = None, severities: list[str] | None = None) -> DataFrame:
    """Violations with their ``phase``: warn, warn-elevated or block; severities outside the list only warn, though they count."""
    out = anchored_counts(df, key, micros, window_s, order)
    phase = F.when(F.col("count") <= warn, "warn").when(F.col("count") > block, "block").otherwise("warn-elevated")
    return out.withColumn("phase", F.when(F.col("severity").isin(severities), phase).otherwise("warn") if severities else phase)


#: Presets: warnings, block threshold and window in seconds.
ESCALATIONS = {"lenient": (3, 5, 60), "strict": (1, 2, 300)}


def graced(triggered: Column, now: Column, until: Column) -> Column:
    """Triggered only once the grace period is over."""
    return triggered & (now >= until)


def token_bucket(df: DataFrame, key: str, micros: str, rate: float, capacity: float, cost: float = 1.0, order: list[str] | None = None) -> DataFrame:
    """Requests against a bucket refilled at ``rate`` a second: ``allowed`` and the ``tokens`` left.

    Rate, capacity and cost are taken as fractions with denominators of a million at most; sums of them are exact.
    """
    return folded(df, key, micros, Bucket(rate, capacity, cost), order)


def user_escalation(df: DataFrame, key: str, micros: str, score: str, most: int = 3, cooldown_s: float = 300, review: float = 0.85, block: float = 0.95, order: list[str] | None = None) -> DataFrame:
    """Violations with ``recent``, ``needs_cooldown``, ``cooldown_left`` (seconds), ``needs_review`` and ``blocked``.

    ``recent`` counts a user's violations of the last ``cooldown_s`` seconds, the current one included, up to ``most``, from which on
    the user has to cool down; one made exactly that long ago counts no more.  Scores decide on review and blocking.
    """
    out = folded(df, key, micros, Recent(int(cooldown_s * 1_000_000), most), order)
    cooling = F.coalesce(F.col("recent") >= most, F.lit(False))
    return out.withColumns({
        "needs_cooldown": cooling, "cooldown_left": F.when(cooling, F.lit(float(cooldown_s))).otherwise(0.0),
        "needs_review": F.coalesce(F.col(score) >= review, F.lit(False)), "blocked": F.coalesce(F.col(score) >= block, F.lit(False)),
    })


def custom_condition(df: DataFrame, key: str, order: list[str], test: Callable[[pd.DataFrame], bool]) -> DataFrame:
    """A user's own condition over the violations so far, for what no window expresses."""
    schema = df.schema.simpleString()[len("struct<") : -1] + ",stop:boolean"

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        rows["stop"] = [bool(test(rows.iloc[: k + 1])) for k in range(len(rows))]
        return rows

    return df.groupBy(key).applyInPandas(fold, schema)


def aborts(severity: Column, at: str = "critical") -> Column:
    return rank(severity) >= rank(F.lit(at))
