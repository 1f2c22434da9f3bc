"""Risk of a plan, read off its sequence of tools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bulwark.functions.regex import Rx
from bulwark.functions.result import let, rank, result
from bulwark.operators.check import Check, Scope

#: Words in tool names, by what the tool does.
DESTRUCTIVE = Rx(r"\b(delete|remove|send|post|transfer|pay|upload|execute|drop)\b", "i")
UNTRUSTED = Rx(r"\b(read|fetch|get|search|load|parse|inbox|email|web|scrape|browse)\b", "i")
PACKAGES = Rx(r"\b(artifactory|registry|package|pip|npm|upload|fetch|list)\b", "i")
EXTERNAL = Rx(r"\b(huggingface|modal|external|internet|ssrf|proxy|bypass)\b", "i")
COORDINATION = Rx(r"\b(seek|message|board|swarm|mailbox|note|claim)\b", "i")
LIST, UPLOAD, FETCH = Rx(r"\blist\b|\bpackages\b"), Rx(r"\bupload\b|\bwrite\b"), Rx(r"\bfetch\b|\bpull\b|\bssrf\b")
LONG_PLAN = 8


def split_name(name: Column) -> Column:
    """snake_case and camelCase as words in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "_", " "), "([a-z0-9])([A-Z])", "$1 $2"))


def classify(tools: Column) -> Column:
    """``verdict, score, category, reason`` of an array of tool names; the first rule that fits decides.

    All names are tested as one text, a line each, with the case folded once.
    """
    verdict = lambda v, s, c, r: F.struct(F.lit(v).alias("verdict"), F.lit(s).alias("score"), F.lit(c).cast("string").alias("category"), F.lit(r).cast("string").alias("reason"))

    def judged(t: Column) -> Column:
        has = lambda rx: t["names"].rlike(rx.java)
        return (
            F.when(t["n"] <= 0, verdict("low", 0.0, None, None))
            .when(has(PACKAGES) & has(LIST) & has(UPLOAD) & has(FETCH), verdict("high", 0.9, "package_manager_ssrf", "list_upload_fetch_registry_chain"))
            .when(has(PACKAGES) & has(COORDINATION), verdict("high", 0.88, "cross_agent_coordination", "registry_used_as_message_board"))
            .when(has(EXTERNAL) & (has(FETCH) | has(UNTRUSTED)), verdict("high", 0.87, "external_eval_cheat", "external_infrastructure_for_eval_answers"))
            .when(has(DESTRUCTIVE) & has(UNTRUSTED), verdict("high", 0.85, "untrusted_to_destructive_chain", "mixed_untrusted_and_destructive_tools"))
            .when(t["n"] >= LONG_PLAN, verdict("medium", 0.55, "long_tool_chain", "long_tool_sequence"))
            .otherwise(verdict("low", 0.1, None, None))
        )

    return let(F.struct(F.coalesce(F.size(tools), F.lit(0)).alias("n"), split_name(F.array_join(tools, "\n")).alias("names")), judged)


def plan_risk(block_at: str = "high", classifier=classify) -> Check:
    """Triggers when the verdict is as high as ``block_at``."""

    def build(s: Scope) -> Column:
        return let(classifier(s.tools), lambda v: result("plan-risk", rank(v["verdict"]) >= rank(F.lit(block_at)), v["verdict"], F.concat(F.lit("Risky plan: "), v["reason"]), confidence=v["score"], category=v["category"]))

    return Check("plan-risk", build, "high")
