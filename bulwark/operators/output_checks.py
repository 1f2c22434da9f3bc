"""Checks of responses."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bulwark.functions import text as tx
from bulwark.functions.regex import Rx
from bulwark.functions.result import highest, let, lowered, result
from bulwark.operators.check import Check, Scope

EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
#: Sensitive data in responses, with severities.
SENSITIVE = {
    "SSN": (Rx(r"\b\d{3}-\d{2}-\d{4}\b"), "high"),
    "API Key": (Rx(r"(?:api[_-]?key|apikey|api_token)[\s:=]*['\"]*([a-zA-Z0-9]{32,})", "i"), "critical"),
    "Credit Card": (Rx(r"\b(?:\d{4}[-\s]?){3}\d{4}\b"), "high"),
    "Email": (Rx(EMAIL), "medium"),
    "Phone": (Rx(r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"), "medium"),
    "AWS Access Key": (Rx(r"AKIA[0-9A-Z]{16}"), "critical"),
    "Private Key": (Rx(r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----"), "critical"),
}
#: Signs of doubt, for the confidence check.
DOUBTS = ["i think", "maybe", "probably", "uncertain", "not sure"]
#: Toxic words in responses.
TOXIC = ["toxic", "harmful", "offensive", "inappropriate"]
#: Hedges and claims of the hallucination check.
HEDGES = [
    "i think", "i believe", "probably", "likely", "might be", "could be", "not sure", "uncertain", "possibly", "perhaps", "maybe",
    "seems like", "appears to be", "my understanding is", "if i recall correctly",
]
CLAIMS = [
    "according to", "studies show", "research indicates", "data suggests", "statistics show", "proven fact", "scientific evidence",
    "documented", "confirmed by", "established that",
]
#: Claims and citations of the accuracy check.
ACCURACY_CLAIMS = [*CLAIMS, "published in", "survey found"]
CITATIONS = ["source:", "reference:", "citation:", "published in", "journal of", "university of", "institute of", "doi:", "isbn:", "url:", "http"]
#: Biased phrases by category.
BIAS = {
    "gender": ["men are better at", "women are better at", "typical male", "typical female", "boys will be boys", "women should", "men should", "ladies", "gentlemen"],
    "racial": ["people of that race", "those people", "their culture", "natural talent", "genetic predisposition", "inherent ability", "cultural background"],
    "age": ["young people today", "older people can't", "millennials are", "boomers are", "too old to", "too young to"],
    "socioeconomic": ["poor people are", "rich people are", "welfare recipients", "privileged class", "working class", "upper class"],
}
#: Private matters by category.
PRIVACY = {
    "personal": Rx(r"\b(john|jane|smith|doe|password|secret|private|confidential)\b", "i"),
    "contact": Rx(EMAIL),
    "phone": Rx(r"\b\d{3}-\d{3}-\d{4}\b"),
    "financial": Rx(r"\b(credit card|ssn|social security|bank account|routing number)\b", "i"),
    "location": Rx(r"\b(address|street|apartment|zip code|postal code)\b", "i"),
}
#: Keywords by regulation.
REGULATIONS = {
    "gdpr": ["personal data", "data processing", "consent", "data subject"],
    "hipaa": ["patient", "medical", "health information", "protected health"],
    "pci": ["credit card", "payment", "cardholder", "card number"],
    "sox": ["financial", "audit", "internal controls", "financial reporting"],
    "coppa": ["children", "under 13", "parental consent", "minor"],
}
#: Formats of secrets.
SECRETS = {
    "API Key": Rx(r"(?:api[_-]?key|apikey|access[_-]?key)\s*[:=]\s*['\"]?([a-zA-Z0-9]{20,})['\"]?", "i"),
    "AWS Access Key": Rx(r"AKIA[0-9A-Z]{16}"),
    "AWS Secret Key": Rx(r"[A-Za-z0-9/+=]{40}"),
    "AWS ARN": Rx(r"arn:aws:[a-zA-Z0-9-]+:[a-zA-Z0-9-]*:[0-9]*:[a-zA-Z0-9\-_/.:*]+"),
    "JWT Token": Rx(r"eyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+"),
    "Bearer Token": Rx(r"Bearer\s+[a-zA-Z0-9_.-]+", "i"),
    "GitHub Token": Rx(r"ghp_[a-zA-Z0-9]{36}"),
    "Google API Key": Rx(r"AIza[0-9A-Za-z_-]{35}"),
    "PEM Certificate/Key": Rx(r"-----BEGIN [A-Z ]+-----[\s\S]*?-----END [A-Z ]+-----"),
    "SSH Private Key": Rx(r"-----BEGIN (RSA|DSA|EC|OPENSSH) PRIVATE KEY-----[\s\S]*?-----END (RSA|DSA|EC|OPENSSH) PRIVATE KEY-----"),
    "Database Connection String": Rx(r"(?:mongodb|postgres|mysql|redis):\/\/[^@\s]+:[^@\s]+@[^/\s]+", "i"),
    "Environment Secret": Rx(r"(?:token|secret|password|key)\s*[:=]\s*['\"]?([a-zA-Z0-9_.-]{16,})['\"]?", "i"),
}
#: Unsafe content by category.
UNSAFE = {
    "Violence": [
        Rx(r"\b(kill|murder|assassinate|torture|bomb|weapon|gun|knife|explosive)\b", "i"),
        Rx(r"\b(harm|hurt|injure|attack|assault|fight)\s+(someone|people|person)", "i"),
        Rx(r"\b(violence|violent|aggression|aggressive)\b", "i"),
    ],
    "Hate Speech": [
        Rx(r"\b(hate|racist|sexist|homophobic|transphobic|xenophobic)\b", "i"),
        Rx(r"\b(nazi|fascist|supremacist|terrorism|terrorist)\b", "i"),
        Rx(r"\b(discrimination|prejudice|bigotry)\b", "i"),
    ],
    "Self-Harm": [
        Rx(r"\b(suicide|self-harm|self-hurt|cut myself|end my life)\b", "i"),
        Rx(r"\b(want to die|kill myself|harm myself)\b", "i"),
        Rx(r"\b(suicidal|depression|self-destruction)\b", "i"),
    ],
    "Illegal Activities": [
        Rx(r"\b(illegal drugs|drug dealing|money laundering|fraud|scam)\b", "i"),
        Rx(r"\b(hack|crack|pirate|steal|burglary|theft)\b", "i"),
        Rx(r"\b(counterfeit|forgery|blackmail|extortion)\b", "i"),
    ],
    "Adult Content": [
        Rx(r"\b(pornography|explicit sexual|adult content|nsfw)\b", "i"),
        Rx(r"\b(sexual explicit|graphic sexual|sexual imagery)\b", "i"),
    ],
    "Personal Information": [Rx(r"\b\d{3}-\d{2}-\d{4}\b"), Rx(r"\b\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\b"), Rx(EMAIL)],
}
#: Claims, citation marks and contradictions of the enhanced hallucination check.
CHECKED_CLAIMS = [
    "according to", "studies show", "research indicates", "data suggests", "statistics show", "proven fact", "scientific evidence",
    "documented", "confirmed by", "published in",
]
CITATION_MARKS = ["[", "(", "doi:", "url:", "source:", "ref:"]
CONTRADICTIONS = [("always", "never"), ("all", "none"), ("definitely", "maybe"), ("certain", "uncertain"), ("true", "false")]
CHECKED_HEDGES = [h for h in HEDGES if h != "my understanding is"]


def max_length(limit: int) -> Check:
    def build(s: Scope) -> Column:
        n = tx.length16(s.text)
        return result("output-length-limit", n > limit, "medium", F.concat(F.lit("Output length "), n.cast("string"), F.lit(f" exceeds limit of {limit}")), length=n, limit=limit)

    return Check("output-length-limit", build)


def min_length(least: int) -> Check:
    def build(s: Scope) -> Column:
        return let(tx.length16(s.text), lambda n: result("min-length-requirement", n < least, "medium", F.concat(F.lit("Output length "), n.cast("string"), F.lit(f" below minimum of {least}")), length=n, deficit=F.greatest(F.lit(least) - n, F.lit(0))))

    return Check("min-length-requirement", build)


def sensitive_data() -> Check:
    """Seven kinds of sensitive data; as severe as the severest found."""

    def build(s: Scope) -> Column:
        severities = F.create_map(*[F.lit(x) for n, (_, sev) in SENSITIVE.items() for x in (n, sev)])

        def judged(found: Column) -> Column:
            return result("sensitive-data-filter", F.size(found) > 0, F.coalesce(highest(F.transform(found, lambda n: severities[n])), F.lit("medium")), F.concat(F.lit("Sensitive data detected: "), F.array_join(found, ", ")), types=F.array_join(found, ", "), count=F.size(found))

        return let(lowered(s.text, lambda t, low: tx.which({n: rx.test(t, low) for n, (rx, _) in SENSITIVE.items()})), judged)

    return Check("sensitive-data-filter", build, "critical")


def blocked_content(words: list[str]) -> Check:
    """The first of the words that occurs anywhere, in any case."""

    def build(s: Scope) -> Column:
        hit = F.coalesce(*[F.when(tx.has(s.lower, w.lower()), F.lit(w)) for w in words])
        return result("blocked-content", hit.isNotNull(), "high", F.concat(F.lit("Blocked content detected: "), hit), word=hit)

    return Check("blocked-content", build)


@F.pandas_udf(T.StringType())
def json_error(texts: pd.Series) -> pd.Series:
    """Why a text isn't strict JSON; null if it is."""

    def error(text: str | None) -> str | None:
        try:
            json.loads(text or "", parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
        except (ValueError, RecursionError) as e:
            return str(e)
        return None

    return texts.map(error)


def json_validation() -> Check:
    """Text that isn't JSON: a wrong first character, or a parse error."""

    def build(s: Scope) -> Column:
        start = tx.trim(s.text).rlike(r'^[{\["]')
        error = json_error(s.text)
        return result("json-validation", s.output.isNull() & (~start | error.isNotNull()), "medium", F.when(~start, "Output is not valid JSON - does not start with valid JSON character").otherwise(F.concat(F.lit("Output is not valid JSON: "), error)), error=F.when(~start, "Invalid JSON prefix").otherwise(error))

    return Check("json-validation", build)


def confidence_threshold(least: float) -> Check:
    def build(s: Scope) -> Column:
        doubtful = tx.count_hits(s.lower, DOUBTS) > 0
        score = F.greatest(F.when(doubtful, 0.5).otherwise(0.9) - F.when(s.finish_reason == "length", 0.2).otherwise(0.0), F.lit(0.0))
        return result("confidence-threshold", score < least, "medium", F.concat(F.lit("Output confidence "), score.cast("string"), F.lit(f" below threshold {least}")), confidence=score, doubtful=doubtful)

    return Check("confidence-threshold", build)


def toxicity_filter(threshold: float = 0.7) -> Check:
    def build(s: Scope) -> Column:
        score = tx.count_hits(s.lower, TOXIC) * F.lit(0.3)
        return result("toxicity-filter", score > threshold, "high", "Content toxicity score exceeds threshold", confidence=score, threshold=threshold)

    return Check("toxicity-filter", build, "high")


def custom_validation(name: str, bad, message: str) -> Check:
    """Triggers when the user's predicate on the scope holds."""
    return Check(name, lambda s: result(name, bad(s), "medium", message))


def schema_validation(schema: str, required: list[str]) -> Check:
    """Objects that don't parse under a DDL schema, or lack a required field; no object at all is of medium severity."""

    def build(s: Scope) -> Column:
        parsed = F.from_json(s.output, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
        missing = F.filter(F.array(*[F.when(parsed[f].isNull(), F.lit(f)) for f in required]), lambda f: f.isNotNull())
        absent = s.output.isNull()
        return result("schema-validation", absent | parsed.isNull() | (F.size(missing) > 0), F.when(absent, "medium").otherwise("high"), F.when(absent, "No object to validate").otherwise(F.concat(F.lit("Schema validation failed: "), F.array_join(missing, ", "))), missing=F.array_join(missing, ","))

    return Check("schema-validation", build)


def token_usage_limit(limit: int) -> Check:
    def build(s: Scope) -> Column:
        return result("token-usage-limit", s.total_tokens > limit, "medium", F.concat(F.lit("Token usage "), s.total_tokens.cast("string"), F.lit(f" exceeds limit of {limit}")), total_tokens=s.total_tokens, limit=limit)

    return Check("token-usage-limit", build)


def performance_monitor(most_ms: float) -> Check:
    def build(s: Scope) -> Column:
        per = lambda n: F.when(s.generation_ms > 0, n / s.generation_ms)
        return result("performance-monitor", s.generation_ms > most_ms, "low", "Generation time exceeds limit", generation_ms=s.generation_ms, tokens_per_ms=per(s.total_tokens), chars_per_ms=per(tx.length16(s.text)))

    return Check("performance-monitor", build)


def hallucination_detector(threshold: float = 0.7) -> Check:
    def build(s: Scope) -> Column:
        hedges, claims = tx.count_hits(s.lower, HEDGES), tx.count_hits(s.lower, CLAIMS)
        score = hedges * F.lit(0.3) + claims * F.lit(0.2)
        return result("hallucination-detector", score > threshold, F.when(score > 0.8, "high").otherwise("medium"), "Potential hallucination detected", confidence=score, hedges=hedges, claims=claims)

    return Check("hallucination-detector", build)


def bias_detector() -> Check:
    def build(s: Scope) -> Column:
        found = tx.which({c: tx.count_hits(s.lower, phrases) > 0 for c, phrases in BIAS.items()})
        total = sum((tx.count_hits(s.lower, p) for p in BIAS.values()), F.lit(0))
        return result("bias-detector", F.size(found) > 0, "medium", F.concat(F.lit("Potential bias detected in categories: "), F.array_join(found, ", ")), categories=F.array_join(found, ", "), matches=total)

    return Check("bias-detector", build)


def factual_accuracy(require_sources: bool = False) -> Check:
    def build(s: Scope) -> Column:
        claims, sources = tx.count_hits(s.lower, ACCURACY_CLAIMS), tx.count_hits(s.lower, CITATIONS)
        return result("factual-accuracy-checker", F.lit(require_sources) & (claims > 0) & (sources == 0), "medium", "Factual claims detected without sources", claims=claims, sources=sources)

    return Check("factual-accuracy-checker", build)


def privacy_leakage() -> Check:
    def build(s: Scope) -> Column:
        def judged(n: Column) -> Column:
            found = tx.which({c: n[k] > 0 for k, c in enumerate(PRIVACY)})
            return result("privacy-leakage-detector", F.size(found) > 0, "critical", F.concat(F.lit("Potential privacy leakage detected: "), F.array_join(found, ", ")), categories=F.array_join(found, ", "), matches=sum((n[k] for k in range(len(PRIVACY))), F.lit(0)))

        return let(lowered(s.text, lambda t, low: F.array(*[rx.count(t, low) for rx in PRIVACY.values()])), judged)

    return Check("privacy-leakage-detector", build, "critical")


def content_consistency(reference: str | None) -> Check:
    """Too few words in common with a reference text."""

    def build(s: Scope) -> Column:
        if not reference:
            return result("content-consistency-checker", F.lit(False))
        return consistency(s.text, F.lit(reference))

    return Check("content-consistency-checker", build)


def consistency(text: Column, reference: Column) -> Column:
    """The consistency check against another column."""
    from bulwark.functions.regex import SPACE

    x, y = F.split(F.lower(text), f"[{SPACE}]+"), F.split(F.lower(reference), f"[{SPACE}]+")
    common = F.size(F.filter(x, lambda w: F.array_contains(y, w)))
    score = common / F.greatest(F.size(x), F.size(y))
    return result("content-consistency-checker", score < 0.3, "medium", F.format_string("Content consistency score too low: %.2f", score), confidence=score, common=common)


def compliance(regulations: list[str] = ()) -> Check:
    def build(s: Scope) -> Column:
        found = tx.which({r.upper(): tx.count_hits(s.lower, REGULATIONS[r.lower()]) > 0 for r in regulations if r.lower() in REGULATIONS}) if regulations else F.array().cast("array<string>")
        return result("compliance-checker", F.size(found) > 0, "high", F.concat(F.lit("Potential compliance violations detected: "), F.array_join(found, ", ")), violations=F.array_join(found, ", "))

    return Check("compliance-checker", build, "high")


def secret_detector() -> Check:
    """Every match of every secret format; one type for each match."""

    def build(s: Scope) -> Column:
        types = lowered(s.text, lambda t, low: F.flatten(F.array(*[F.array_repeat(F.lit(n), rx.count(t, low)) for n, rx in SECRETS.items()])))
        return let(types, lambda x: result("secret-redaction", F.size(x) > 0, "critical", F.concat(F.lit("Output contains "), F.size(x).cast("string"), F.lit(" potential secret(s): "), F.array_join(x, ", ")), types=F.array_join(x, ", "), count=F.size(x)))

    return Check("secret-redaction", build, "critical")


def unsafe_content() -> Check:
    def build(s: Scope) -> Column:
        counts = lowered(s.text, lambda t, low: F.array(*[sum((rx.count(t, low) for rx in rxs), F.lit(0)) for rxs in UNSAFE.values()]))
        issues = let(counts, lambda n: F.concat_ws(", ", *[F.when(n[k] > 0, F.concat(F.lit(f"{c} ("), n[k].cast("string"), F.lit(")"))) for k, c in enumerate(UNSAFE)]))
        return let(issues, lambda x: result("unsafe-content-detector", x != "", "high", F.concat(F.lit("Unsafe content detected: "), x), issues=x))

    return Check("unsafe-content-detector", build, "high")


def cost_quota(max_tokens: int | None = None, max_cost: float | None = None, per_thousand: float | None = None) -> Check:
    """Limits of one request; absent or zero limits are off."""

    def build(s: Scope) -> Column:
        tokens = F.coalesce(s.total_tokens, F.lit(0))
        cost = tokens / F.lit(1000.0) * F.lit(per_thousand or 0.0)
        over_tokens = tokens > (max_tokens or 0) if max_tokens else F.lit(False)
        over_cost = cost > (max_cost or 0.0) if max_cost else F.lit(False)
        issues = F.concat_ws(", ", F.when(over_tokens, F.concat(F.lit("Token usage ("), tokens.cast("string"), F.lit(f") exceeds limit ({max_tokens})"))), F.when(over_cost, F.format_string(f"Estimated cost ($%.4f) exceeds limit (${max_cost})", cost)))
        return result("cost-quota-rails", issues != "", "high", F.concat(F.lit("Cost/quota limits exceeded: "), issues), total_tokens=tokens, cost=cost)

    return Check("cost-quota-rails", build, "high")


def enhanced_hallucination(
    require_citations: bool = False, citation_formats: list[str] | None = None, claims: list[str] | None = None, threshold: float = 0.7,
    required_fields: list[str] = (), allowed_values: dict[str, list[str]] | None = None,
) -> Check:
    """Uncited claims, hedged claims, contradictions, and fields of the object that are missing or out of range."""

    def build(s: Scope) -> Column:
        n_claims = tx.count_hits(s.lower, [c.lower() for c in claims or CHECKED_CLAIMS])
        n_marks = tx.count_hits(s.lower, [c.lower() for c in citation_formats or CITATION_MARKS])
        hedges = tx.count_hits(s.lower, CHECKED_HEDGES)
        steps = [
            (F.lit(require_citations) & (n_claims > 0) & (n_marks == 0), F.lit(0.4), "claims without citations"),
            ((hedges > 0) & (n_claims > 0), hedges * F.lit(0.1), "uncertainty with claims"),
        ]
        field = lambda f: F.get_json_object(s.output, f"$.{f}")
        if required_fields:
            missing = sum((field(f).isNull().cast("int") for f in required_fields), F.lit(0))
            steps.append((s.output.isNotNull() & (missing > 0), F.lit(0.3), "missing required fields"))
        for f, values in (allowed_values or {}).items():
            steps.append((field(f).isNotNull() & ~field(f).isin(values), F.lit(0.2), f"invalid value for {f}"))
        for pos, neg in CONTRADICTIONS:
            steps.append((tx.has(s.lower, pos) & tx.has(s.lower, neg), F.lit(0.15), f"contradiction {pos}/{neg}"))
        score = F.lit(0.0)
        for test, add, _ in steps:
            score = score + F.when(test, add).otherwise(0.0)
        issues = F.concat_ws("; ", *[F.when(test, F.lit(label)) for test, _, label in steps])
        return result("enhanced-hallucination-detector", score > threshold, F.when(score > 0.8, "high").otherwise("medium"), F.concat(F.lit("Potential hallucination detected: "), issues), confidence=score, issues=issues, hedges=hedges, claims=n_claims)

    return Check("enhanced-hallucination-detector", build)


def retry_after(max_delay_ms: int = 60000, backoff_ms: int = 1000, jitter: float = 0.1, seed: int | None = 7) -> Check:
    """Slow or large responses, with a suggested delay; ``seed`` makes the jitter repeatable."""

    def build(s: Scope) -> Column:
        limited = (s.generation_ms > 5000) | (s.total_tokens > 10000)
        delay = F.least(F.lit(2.0 * backoff_ms) + (F.rand(seed) if seed is not None else F.rand()) * F.lit(jitter * backoff_ms), F.lit(float(max_delay_ms)))
        return result("retry-after", limited, "medium", "Rate limit indicators detected", retry_after_ms=F.when(limited, F.round(delay)))

    return Check("retry-after", build)
