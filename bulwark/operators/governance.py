"""Decisions about blocked results and guarded tools, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.functions.result import risk


def risk_score(result: Column) -> Column:
    """The result's confidence, else its severity's risk."""
    return F.coalesce(result["confidence"], risk(result["severity"]))


def decision(action: Column | str, resource: Column, verdict: Column | str, score: Column, reason: Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(action).alias("action"), resource.alias("resource"), lit(verdict).alias("decision"), score.cast("double").alias("risk_score"), reason.alias("reason"))


def denials(guarded: DataFrame, key: str) -> DataFrame:
    """One ``deny`` for every blocked result of a guarded DataFrame."""
    rows = guarded.select(key, F.explode("summary.blocked_results").alias("r"))
    return rows.select(key, decision("guardrail", F.coalesce(F.col("r.guardrail_name"), F.lit("guardrail")), "deny", risk_score(F.col("r")), F.col("r.message")).alias("d")).select(key, "d.*")


def approval_decision(status: Column) -> Column:
    """permit, deny or challenge for an approval status."""
    return F.when(status == "denied", "deny").when(status == "user-approval", "challenge").otherwise("permit")


def scope_decision(required: Column, granted: Column) -> Column:
    """deny with the missing scopes, else permit."""
    missing = F.array_except(required, granted)
    return F.struct(F.when(F.size(missing) > 0, "deny").otherwise("permit").alias("decision"), F.array_join(missing, ",").alias("missing"))


def plan_risk_events(plans: DataFrame, key: str, verdict: str = "verdict") -> DataFrame:
    """Observed plans above low risk."""
    return plans.filter(F.col(verdict) != "low").select(key, F.lit("plan_risk").alias("event"), F.col(verdict).alias("detail"))
