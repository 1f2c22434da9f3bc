"""Evaluating checks against labelled samples, and watching them at work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """Quotient, 0 where there is nothing to divide by."""
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(outcomes: DataFrame) -> DataFrame:
    """Metrics per guardrail of ``guardrail, expected, actual`` (a missing actual counts as false)."""
    actual = F.coalesce(F.col("actual"), F.lit(False))
    counts = outcomes.filter("expected is not null").groupBy("guardrail").agg(
        F.count_if(F.col("expected") & actual).alias("tp"), F.count_if(~F.col("expected") & ~actual).alias("tn"),
        F.count_if(~F.col("expected") & actual).alias("fp"), F.count_if(F.col("expected") & ~actual).alias("fn"),
    )
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumn("precision", precision).withColumn("recall", recall)
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))


def overall_accuracy(outcomes: DataFrame) -> DataFrame:
    """Share of agreeing pairs, of those with an actual value."""
    known = outcomes.filter("expected is not null and actual is not null")
    return known.agg(ratio(F.count_if(F.col("expected") == F.col("actual")), F.count("*")).alias("accuracy"))


def outcomes_of(samples: DataFrame) -> DataFrame:
    """``sample_id, guardrail, expected, actual`` of samples with maps ``expected`` and ``actual``."""
    long = samples.select("sample_id", "actual", F.explode("expected").alias("guardrail", "expected"))
    return long.select("sample_id", "guardrail", "expected", F.try_element_at("actual", F.col("guardrail")).alias("actual"))


def sample_results(samples: DataFrame) -> DataFrame:
    """Samples with their ``mismatches`` and whether they ``passed``."""
    names = F.map_keys("expected")
    wrong = F.filter(names, lambda n: F.element_at(F.col("expected"), n) != F.coalesce(F.try_element_at(F.col("actual"), n), F.lit(False)))
    return samples.withColumn("mismatches", wrong).withColumn("passed", F.size("mismatches") == 0)


def execution_stats(times: DataFrame, key: list[str], column: str) -> DataFrame:
    """Mean, nearest-rank percentiles, least and most of times above zero."""
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by {column})")
    return times.filter(F.col(column) > 0).groupBy(*key).agg(F.avg(column).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.min(column).alias("least"), F.max(column).alias("most"))


def top_performers(metrics: DataFrame, least: float = 0.9, n: int = 5) -> DataFrame:
    return metrics.filter(F.col("f1") >= least).orderBy(F.desc("f1"), "guardrail").limit(n)


def weak_performers(metrics: DataFrame, below: float = 0.7, n: int = 5) -> DataFrame:
    """The last by F1, with what is wrong with each."""
    issues = F.concat_ws("; ", F.when(F.col("precision") < 0.7, "low precision"), F.when(F.col("recall") < 0.7, "low recall"), F.when(F.col("fp") > F.col("tp"), "more false than true positives"))
    return metrics.filter(F.col("f1") < below).orderBy("f1", "guardrail").limit(n).withColumn("issues", issues)


def recommendations(metrics: DataFrame) -> DataFrame:
    """Advice per guardrail."""
    said = F.array(F.when(F.col("accuracy") < 0.8, "review patterns: accuracy below 80%"), F.when(F.col("fp") > F.col("tp"), "tighten: more false than true positives"), F.when(F.col("recall") < 0.5, "loosen: recall below 50%"))
    return metrics.select("guardrail", F.filter(said, lambda x: x.isNotNull()).alias("advice"))


def guardrail_metrics(executions: DataFrame) -> DataFrame:
    """Counters of ``guardrail, triggered, severity, is_error, ms, ts`` per guardrail, with exact percentiles."""
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by ms)")
    by = [F.count_if(F.col("triggered") & (F.col("severity") == s)).alias(f"blocked_{s}") for s in ("low", "medium", "high", "critical")]
    out = executions.groupBy("guardrail").agg(
        F.count("*").alias("executions"), F.count_if("triggered").alias("blocked"), F.count_if("is_error").alias("errors"), *by,
        F.sum("ms").alias("total_ms"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )
    return out.withColumn("block_rate", ratio(F.col("blocked"), F.col("executions"))).withColumn("error_rate", ratio(F.col("errors"), F.col("executions"))).withColumn("mean_ms", ratio(F.col("total_ms"), F.col("executions")))


def health(metrics: DataFrame, error_rate: float = 0.1, block_rate: float = 0.5) -> DataFrame:
    """``status`` of each guardrail: unhealthy by errors, degraded by blocks, else healthy."""
    status = F.when(F.col("error_rate") > error_rate, "unhealthy").when(F.col("block_rate") > block_rate, "degraded").otherwise("healthy")
    return metrics.withColumn("status", status)


def overall_health(metrics: DataFrame) -> DataFrame:
    """The worst status."""
    worst = F.max(F.when(F.col("status") == "unhealthy", 2).when(F.col("status") == "degraded", 1).otherwise(0))
    return metrics.agg(worst.alias("w")).select(F.element_at(F.array(*map(F.lit, ("healthy", "degraded", "unhealthy"))), F.col("w") + 1).alias("status"))


def dataset_stats(samples: DataFrame) -> DataFrame:
    """Counts by category and difficulty, and mean number of expectations."""
    return samples.groupBy(F.coalesce("category", F.lit("uncategorized")).alias("category"), F.coalesce("difficulty", F.lit("unspecified")).alias("difficulty")).agg(F.count("*").alias("samples"), F.avg(F.size("expected")).alias("mean_triggers"))


def filter_samples(samples: DataFrame, categories: list[str] = (), difficulty: list[str] = (), ids: list[str] = ()) -> DataFrame:
    """Samples that match every filter given; a missing field matches none."""
    for column, values in (("category", categories), ("difficulty", difficulty), ("id", ids)):
        if values:
            samples = samples.filter(F.col(column).isin(list(values)))
    return samples
