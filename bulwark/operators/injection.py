"""The multi-factor injection detector and its presets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bulwark.functions import text as tx
from bulwark.functions.normalize import Normalization, normalize
from bulwark.functions.regex import Rx
from bulwark.functions.result import let, lowered, result
from bulwark.operators.check import Check, Scope

#: Patterns of the score, with weights.
PATTERNS = [
    (Rx(r"ignore\s+previous\s+instructions", "i"), 0.9),
    (Rx(r"system\s*:\s*you\s+are\s+now", "i"), 0.8),
    (Rx(r"forget\s+everything\s+above", "i"), 0.9),
    (Rx(r"call\s+(\w+)\s+with\s+malicious\s+params", "i"), 0.9),
    (Rx(r"override\s+function\s+(\w+)", "i"), 0.95),
    (Rx(r"now\s+that\s+you\s+are\s+in\s+(\w+)\s+mode", "i"), 0.8),
    (Rx(r"(?:security\s+team|administrator|system\s+admin|emergency|urgent)", "i"), 0.7),
]
#: Suspicious tool calls.
TOOL_CALLS = [
    (Rx(r"call\s+(\w+)\s+with\s+malicious\s+params", "i"), "parameter_manipulation"),
    (Rx(r"override\s+function\s+(\w+)", "i"), "function_override"),
    (Rx(r"chain\s+(\w+)\s+to\s+(\w+)\s+to\s+(\w+)", "i"), "tool_chain_attack"),
    (Rx(r"execute\s+(\w+)\s+as\s+root", "i"), "function_override"),
]
#: Flow, semantic and behaviour signs.
FLOW = [Rx(r"suddenly\s+change", "i"), Rx(r"now\s+forget", "i"), Rx(r"switch\s+to", "i"), Rx(r"pretend\s+you\s+are", "i")]
SEMANTIC = [Rx("ignore|forget|disregard", "i"), Rx("override|bypass|skip", "i"), Rx("system|admin|root", "i"), Rx("emergency|urgent|critical", "i")]
BEHAVIOUR = ["ignore previous", "system:", "forget everything", "act as if", "pretend to be"]
#: Weights of pattern, coherence, flow, semantic and behaviour scores.
WEIGHTS = {"pattern": 0.4, "context": 0.2, "flow": 0.2, "semantic": 0.1, "behavior": 0.1}
#: Manipulation signs and intents, in the order they are tried.
MANIPULATION = {"instruction_ignoring": "ignore|forget|disregard", "authority_claim": "system|admin|root", "system_override": "override|bypass"}
INTENTS = {"help_request": "help|assist|support", "information_request": "explain|describe|tell", "creation_request": "create|generate|make"}


def raw_pattern_score(text: Column) -> Column:
    """Mean weight of the patterns found, at most 1."""

    def scored(hits: Column) -> Column:
        total, count = F.lit(0.0), F.lit(0)
        for k, (_, weight) in enumerate(PATTERNS):
            total, count = total + F.when(hits[k], weight).otherwise(0.0), count + hits[k].cast("int")
        return F.when(count > 0, F.least(total / count, F.lit(1.0))).otherwise(0.0)

    return let(lowered(text, lambda t, lower: F.array(*[rx.test(t, lower) for rx, _ in PATTERNS])), scored)


def pattern_score(text: Column, normalization: bool | dict | Normalization = True) -> Column:
    """The higher score of the raw and the normalized text."""
    score = raw_pattern_score(text)
    return score if normalization is False else F.greatest(score, let(normalize(text, normalization), raw_pattern_score))


def coherence(text: Column) -> Column:
    """1, less 0.2 for each pair of adjacent sentences with hardly a word in common; 0 without sentences."""
    # words once a sentence, not once for each neighbour
    sentences = F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: tx.words(F.lower(s))), lambda w: F.size(w) > 0)
    few = lambda x, y: F.size(F.filter(x, lambda w: F.array_contains(y, w))) / F.greatest(F.size(x), F.size(y)) < 0.2
    each = lambda w: F.aggregate(
        w, F.struct(F.lit(None).cast("array<string>").alias("last"), F.lit(1.0).alias("score")),
        lambda a, x: F.struct(x.alias("last"), F.when(a["last"].isNotNull() & few(a["last"], x), a["score"] - 0.2).otherwise(a["score"]).alias("score")),
        lambda a: F.greatest(a["score"], F.lit(0.0)),
    )
    return let(sentences, lambda w: F.when(F.size(w) == 0, 0.0).otherwise(each(w)))


def less(start: float, step: float, tests: list[Column]) -> Column:
    """``start`` less ``step`` for each test that holds, one after another, not below 0."""
    lowers = F.filter(F.array(*tests), lambda t: t)
    return F.aggregate(lowers, F.lit(float(start)), lambda a, _: a - step, lambda a: F.greatest(a, F.lit(0.0)))


def flow(text: Column) -> Column:
    """Flow score of plain text; contexts with messages count 0.8 throughout."""
    return less(1.0, 0.3, [rx.test(text) for rx in FLOW])


def semantic(text: Column) -> Column:
    return less(1.0, 0.2, [rx.test(text) for rx in SEMANTIC])


def behaviour(context_json: Column) -> Column:
    lower = F.lower(context_json)
    return F.greatest(1 - tx.count_hits(lower, BEHAVIOUR) * F.lit(0.2), F.lit(0.0))


def weighted(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    weights = WEIGHTS | (weights or {})
    total = None
    for name in WEIGHTS:
        term = scores[name] * F.lit(weights[name])
        total = term if total is None else total + term
    return total


def intent(text: Column) -> Column:
    """``primary, confidence, manipulation`` of a prompt."""
    signs = tx.which({n: Rx(p, "i").test(text) for n, p in MANIPULATION.items()})
    primary = F.coalesce(*[F.when(Rx(p, "i").test(text), F.lit(n)) for n, p in INTENTS.items()], F.lit("general_query"))
    return F.struct(primary.alias("primary"), F.when(F.size(signs) > 0, 0.3).otherwise(0.8).alias("confidence"), signs.alias("manipulation"))


def tool_calls(text: Column) -> Column:
    """Every suspicious tool call: ``tool, injection``."""
    parts = [named(rx.all(text, 1), kind) for rx, kind in TOOL_CALLS]
    return F.flatten(F.array(*parts))


def named(tools: Column, kind: str) -> Column:
    return F.transform(tools, lambda t: F.struct(t.alias("tool"), F.lit(kind).alias("injection")))


def enhanced_score(text: Column, context_json: Column, normalization=True, weights: dict[str, float] | None = None) -> Column:
    """The weighted sum; note that four of its parts are highest for harmless text."""
    scores = {"pattern": pattern_score(text, normalization), "context": coherence(text), "flow": F.lit(0.8), "semantic": semantic(text), "behavior": behaviour(context_json)}
    return weighted(scores, weights)


def history_score(contents: Column, memory: int = 10, normalization=True) -> Column:
    """Mean pattern score of the last ``memory`` messages; null without any.

    Built-ins only: normalization inside an array runs without Unicode composition.
    """
    plain = False if normalization is False else {"unicode": False}
    recent = F.slice(contents, F.greatest(F.size(contents) - (max(memory, 1) - 1), F.lit(1)), F.lit(max(memory, 1)))
    scores = F.transform(recent, lambda c: pattern_score(c, plain))
    return F.when(F.size(contents) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores))


def context_shifts(contents: Column, memory: int = 10) -> Column:
    """Adjacent messages, of the last ``memory``, that share few words."""
    recent = F.slice(contents, F.greatest(F.size(contents) - (memory - 1), F.lit(1)), F.lit(memory))
    pairs = F.zip_with(recent, F.slice(recent, F.lit(2), F.lit(memory)), lambda a, b: F.when(b.isNotNull() & (tx.overlap(a, b) < 0.3), 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0), lambda a, x: a + x)


def enhanced_detector(
    incremental: bool = True, tool_focus: bool = True, intents: bool = True, threshold: float = 0.7, cumulative: float = 0.5, memory: int = 10,
    weights: dict[str, float] | None = None, normalization: bool | dict | Normalization = True, contents: Column | None = None, context_json: Column | None = None,
) -> Check:
    """Triggers on the weighted score, on the mean of the history, or on a suspicious tool call."""

    def judged(m: Column) -> Column:
        score, history, calls = m["score"], m["history"], m["calls"]
        hit = score > threshold
        if incremental:
            hit = hit | (F.coalesce(history, score) > cumulative)
        if tool_focus:
            hit = hit | (calls > 0)
        extra = {"intent": m["intent"]} if intents else {}
        return result(
            "enhanced-prompt-injection", hit, F.when(score > 0.8, "critical").otherwise("high"), F.format_string("Enhanced prompt injection detected (confidence: %.1f%%)", score * 100),
            "Please rephrase your request", score, history=F.coalesce(history, score), calls=calls, **extra,
        )

    def build(s: Scope) -> Column:
        score = enhanced_score(s.text, s.text if context_json is None else context_json, normalization, weights)
        history = F.lit(None).cast("double") if contents is None else history_score(contents, memory, normalization)
        parts = F.struct(score.alias("score"), history.alias("history"), F.size(tool_calls(s.text)).alias("calls"), intent(s.text)["primary"].alias("intent"))
        return let(parts, judged)

    return Check("enhanced-prompt-injection", build, "critical")


def incremental_detector(**options) -> Check:
    """History only."""
    return enhanced_detector(**{"incremental": True, "tool_focus": False, "intents": False} | options)


def tool_call_detector(**options) -> Check:
    """Tool calls only."""
    return enhanced_detector(**{"incremental": False, "tool_focus": True, "intents": False} | options)


def intent_detector(**options) -> Check:
    """Intents only."""
    return enhanced_detector(**{"incremental": False, "tool_focus": False, "intents": True} | options)
