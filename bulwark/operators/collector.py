"""Metrics of executions in slices of time that add up: a slice holds counters, a quantile sketch and a bounded sample.

Slices of any interval merge into one by sums and by merging sketches and samples, so intervals need not be known when
executions are collected, and nothing is ever sorted as a whole.  Quantiles come from a KLL sketch: with ``K`` of 400 the
rank of what is returned differs from the one asked for by less than 1 % (in tests, against exact ranks).  A sample holds
the ``SAMPLE`` executions of the smallest hash, the same ones whichever way slices are cut and merged.

Defined cases: a null time of execution counts as an execution but enters neither sketch nor sample; a null severity of a
violation is medium; executions without a timestamp are left to a slice of their own (null); an empty table gives no slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bulwark.functions.result import SEVERITIES

#: Accuracy of sketches, and executions in a sample.
K, SAMPLE = 400, 1000


def _counters() -> list[Column]:
    hit = F.col("triggered")
    severity = F.coalesce("severity", F.lit("medium"))
    return [
        F.count("*").alias("executions"), F.count_if(hit).alias("blocked"), F.count_if("is_error").alias("errors"), *[F.count_if(hit & (severity == s)).alias(f"blocked_{s}") for s in SEVERITIES],
        F.count("ms").alias("timed"), F.sum("ms").alias("total_ms"), F.min("ms").alias("least_ms"), F.max("ms").alias("most_ms"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.max(F.when(hit, F.col("ts"))).alias("last_violation"), F.kll_sketch_agg_double(F.col("ms").cast("double"), F.lit(K)).alias("sketch"),
    ]


def _of_ids(ids: Column, share: float) -> Column:
    """A share of all ids, the same ones in every run."""
    return F.pmod(F.xxhash64(ids), F.lit(1_000_000)) < int(share * 1_000_000)


def slices(executions: DataFrame, seconds: int = 60, share: float = 1.0) -> DataFrame:
    """One row for each ``guardrail`` and ``slice`` (its start) of ``execution_id, guardrail, triggered, severity, is_error, ms, ts``.

    With ``share`` below one, only that share of executions is collected, by their ids.
    """
    kept = executions if share >= 1 else executions.filter(_of_ids(F.col("execution_id"), share))
    start = F.timestamp_seconds(F.floor(F.unix_micros("ts") / F.lit(1_000_000 * seconds)) * seconds)
    return kept.withColumn("slice", start).groupBy("guardrail", "slice").agg(*_counters())


def live_slices(executions: DataFrame, seconds: int = 60, late: str = "5 minutes") -> DataFrame:
    """The same over a live stream; a slice comes out once no execution later than ``late`` can belong to it."""
    out = executions.withWatermark("ts", late).groupBy("guardrail", F.window("ts", f"{seconds} seconds").alias("w")).agg(*_counters())
    return out.withColumn("slice", F.col("w.start")).drop("w")


def merged(parts: DataFrame, *by: Column | str) -> DataFrame:
    """Slices added up by ``guardrail`` and whatever else ``by`` says, such as ``date_trunc('day', slice)``."""
    sums = ["executions", "blocked", "errors", *[f"blocked_{s}" for s in SEVERITIES], "timed", "total_ms"]
    return parts.groupBy("guardrail", *by).agg(
        *[F.sum(c).alias(c) for c in sums], F.min("least_ms").alias("least_ms"), F.max("most_ms").alias("most_ms"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max("last_violation").alias("last_violation"), F.kll_merge_agg_double("sketch", F.lit(K)).alias("sketch"),
    )


def summarised(parts: DataFrame) -> DataFrame:
    """Rates, mean and quantiles in place of sums and sketches."""
    some = F.col("timed") > 0
    at = lambda p: F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))))
    share = lambda c: F.col(c) / F.col("executions")
    return parts.withColumns({
        "mean_ms": F.when(some, F.col("total_ms") / F.col("timed")), "p50_ms": at(0.5), "p95_ms": at(0.95), "p99_ms": at(0.99), "block_rate": share("blocked"), "error_rate": share("errors"),
    }).drop("sketch", "total_ms")


def totals(parts: DataFrame) -> DataFrame:
    """One row over all guardrails: executions, blocks, errors and their rates, and the mean time."""
    out = parts.agg(F.sum("executions").alias("executions"), F.sum("blocked").alias("blocked"), F.sum("errors").alias("errors"), F.sum("timed").alias("timed"), F.sum("total_ms").alias("total_ms"), F.min("first_seen").alias("period_start"), F.max("last_seen").alias("period_end"))
    return out.select("executions", "blocked", "errors", (F.col("blocked") / F.col("executions")).alias("block_rate"), (F.col("total_ms") / F.col("timed")).alias("mean_ms"), "period_start", "period_end")


def sample(executions: DataFrame, size: int = SAMPLE, *by: str) -> DataFrame:
    """``size`` executions of each ``guardrail`` (and ``by``): those of the smallest hash of ``execution_id``, with that hash as ``place``.

    Samples of parts, put together and sampled again, are the sample of the whole; maps keep ``size`` rows a guardrail before they shuffle.
    """
    place = F.xxhash64("execution_id") if "place" not in executions.columns else F.col("place")
    first = F.row_number().over(W.partitionBy("guardrail", *by).orderBy("place", "execution_id"))
    return executions.filter(F.col("ms").isNotNull()).withColumn("place", place).withColumn("__n", first).filter(F.col("__n") <= size).drop("__n")
