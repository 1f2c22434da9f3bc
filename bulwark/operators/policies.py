"""Policies over categories of patterns: regulated advice, role hierarchy, ending of streams, factual claims, and redaction of logs."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bulwark.functions import text as tx
from bulwark.functions.regex import Rx
from bulwark.functions.result import SEVERITIES, let, lowered

#: Kinds of regulated advice with severities.
ADVICE = {
    "financialAdvice": ("medium", [
        "(invest|investment|investing|investor)", "(stock|stocks|equity|equities|shares)", "(bond|bonds|fixed income|treasury)", "(mutual fund|etf|index fund|portfolio)",
        "(retirement|401k|ira|pension)", "(tax|taxes|taxation|deduction|credit)", "(insurance|policy|coverage|premium)", "(mortgage|loan|credit|debt|interest)",
        "(budget|savings|expense|income)", "(financial planning|wealth management|estate planning)", "(buy|sell|hold|trade|market)", "(return|yield|dividend|capital gains)",
        "(risk|volatility|diversification)",
    ]),
    "medicalAdvice": ("high", [
        "(diagnose|diagnosis|diagnostic)", "(treat|treatment|therapy|therapeutic)", "(medication|medicine|drug|prescription)", "(symptom|symptoms|condition|disease|illness)",
        "(doctor|physician|specialist|surgeon)", "(hospital|clinic|medical center)", "(surgery|operation|procedure)", "(test|testing|lab|laboratory)", "(pain|ache|hurt|injury)",
        "(fever|temperature|blood pressure)", "(cure|heal|recovery|rehabilitation)", "(prevent|prevention|vaccine|immunization)", "(pregnant|pregnancy|birth|delivery)",
        "(mental health|psychology|psychiatry|therapy)",
    ]),
    "legalAdvice": ("medium", [
        "(legal|law|lawyer|attorney|solicitor)", "(contract|agreement|terms|conditions)", "(litigation|lawsuit|court|judge)", "(rights|legal rights|entitlement)",
        "(liability|responsibility|obligation)", "(compliance|regulation|statute|ordinance)", "(intellectual property|patent|trademark|copyright)",
        "(employment|labor|workplace|discrimination)", "(family law|divorce|custody|adoption)", "(criminal|crime|offense|penalty)", "(civil|tort|damages|compensation)",
        "(real estate|property|landlord|tenant)", "(bankruptcy|debt|creditor)", "(estate|will|trust|inheritance)",
    ]),
    "taxAdvice": ("medium", [
        "(tax|taxes|taxation|irs|hmrc)", "(deduction|deductible|credit|exemption)", "(filing|return|form|schedule)", "(audit|examination|review)", "(penalty|fine|interest|late)",
        "(business tax|corporate tax|personal tax)", "(capital gains|loss|depreciation)", "(estate tax|gift tax|inheritance)", "(sales tax|vat|excise)",
        "(tax planning|avoidance|evasion)",
    ]),
    "realEstateAdvice": ("low", [
        "(real estate|property|realty)", "(buy|sell|purchase|sale)", "(mortgage|loan|financing)", "(appraisal|valuation|assessment)", "(inspection|survey|title)",
        "(closing|escrow|settlement)", "(commission|fee|cost)", "(market value|price|listing)", "(landlord|tenant|lease|rental)", "(zoning|permit|code|regulation)",
    ]),
}
#: Violations of the hierarchy of roles with severity and confidence, in the order they are reported.
HIERARCHY = {
    "role_confusion": ("high", 0.9, [
        "act as a system", "pretend to be the system", "you are now the system", "switch to system mode", "become the assistant", "take on the role of", "roleplay as", "impersonate",
        "masquerade as",
    ]),
    "instruction_override": ("critical", 0.95, [
        "ignore previous instructions", "forget the system prompt", "disregard your training", "override your instructions", "bypass your constraints",
        "ignore your safety measures", "disregard your role", "forget who you are", "ignore your programming",
    ]),
    "priority_manipulation": ("high", 0.85, [
        "this is more important than", "override everything else", "this takes precedence", "ignore all other rules", "this is the highest priority",
        "supersede all instructions", "this is critical", "emergency override",
    ]),
    "context_manipulation": ("medium", 0.8, [
        "clear the conversation", "reset the context", "start fresh", "new conversation", "forget everything", "wipe memory", "clear history", "reset session",
    ]),
    "developer_instruction": ("critical", 0.9, [
        "^developer:", "^dev:", "^admin:", "^root:", "^superuser:", "^privileged:", "^internal:", "^debug:", "^test:", "^config:",
    ]),
    "system_role_usurpation": ("critical", 0.9, ["^system:", "^assistant:", "^ai:", "^bot:", "^model:", "^agent:", "^expert:", "^specialist:"]),
    "user_role_impersonation": ("medium", 0.7, ["^user:", "^human:", "^person:", "^client:", "^customer:", "^end.?user:"]),
}
#: What may end a stream, with severity and whether it does so at once.
ENDINGS = {
    "dangerous": ("critical", True, [
        r"kill\s*yourself|suicide|self\s*harm|end\s*life", "bomb|explosive|terrorism|attack", r"child\s*abuse|pedophilia|exploitation", "hack|breach|steal|illegal",
    ]),
    "highRisk": ("high", True, [r"hate\s*speech|discrimination|racism|sexism", "threat|violence|harm|attack", "harassment|bullying|abuse", "inappropriate|sexual|lewd"]),
    "sensitive": ("medium", False, ["medical|diagnosis|treatment|prescription", "legal|attorney|lawyer|court", "financial|investment|money|banking", "personal|private|confidential"]),
    "quality": ("low", False, ["incomplete|unclear|confusing", "error|mistake|incorrect", r"low\s*quality|poor|bad", "inconsistent|contradictory"]),
    "compliance": ("high", True, [r"gdpr|privacy|data\s*protection", r"hipaa|medical\s*privacy", r"sox|financial\s*compliance", "regulatory|compliance"]),
}
ENDING_CONFIDENCE, ENDING_LENGTH, ENDING_MS, ENDING_VIOLATIONS, ENDING_WINDOW_MS = 0.7, 10_000, 30_000, 3, 5_000
#: Factual claims by kind, and words that hedge them.
CLAIMS = {
    "factualClaims": [
        "according to (research|studies|data|statistics)", "(research|studies|data) (shows|indicates|demonstrates|proves)", "(statistics|data) (show|indicate|demonstrate|prove)",
        "(scientists|researchers|experts) (found|discovered|concluded)", "(study|research) (found|discovered|concluded)", "(percentage|percent|%) of", "(number|amount|total) of",
        "(date|year|month|day) (was|is|will be)", "(location|place|city|country) (is|was|will be)", "(person|company|organization) (said|stated|announced)",
    ],
    "citationRequired": [
        "(research|study|paper|article) (by|from|published)", "(book|journal|publication) (by|from|published)", "(author|researcher|scientist) (wrote|published|found)",
        "(source|reference|citation) (says|states|indicates)",
    ],
    "currentEvents": [
        "(recently|lately|currently|now) (announced|released|published)", "(latest|new|recent) (data|information|research)", "(this|last) (week|month|year)",
        "(today|yesterday|tomorrow)", "(breaking|news|update)",
    ],
    "numericalClaims": [
        r"(\d+(?:\.\d+)?)\s*(percent|%|million|billion|thousand)", r"(more than|less than|approximately|about|around)\s*\d+", r"(between|from)\s*\d+\s*(and|to)\s*\d+",
        r"(increased|decreased|grew|declined)\s*by\s*\d+",
    ],
}
HEDGES = [
    "may", "might", "could", "possibly", "potentially", "seems", "appears", "suggests", "indicates", "likely", "probably", "perhaps", "maybe", "allegedly", "reportedly", "supposedly",
    "according to some", "some sources suggest", "it has been suggested", "there is some evidence",
]
SPECIFIC = ["exactly", "precisely", "definitely"]
CLAIM_BEFORE, CLAIM_AFTER = 50, 100
#: Sensitive parts of log entries by kind, with what becomes of them.
LOG_DATA = {
    "authTokens": ("hash", [
        r"Bearer\s+[A-Za-z0-9\-._~+/]+=*", r"""token["\s]*[:=]\s*["']?[A-Za-z0-9\-._~+/]+=*["']?""", r"""api[_-]?key["\s]*[:=]\s*["']?[A-Za-z0-9\-._~+/]+=*["']?""",
        r"""access[_-]?token["\s]*[:=]\s*["']?[A-Za-z0-9\-._~+/]+=*["']?""", r"""refresh[_-]?token["\s]*[:=]\s*["']?[A-Za-z0-9\-._~+/]+=*["']?""",
    ]),
    "credentials": ("remove", [
        r"""password["\s]*[:=]\s*["']?[^"'\s]+["']?""", r"""passwd["\s]*[:=]\s*["']?[^"'\s]+["']?""", r"""pwd["\s]*[:=]\s*["']?[^"'\s]+["']?""",
        r"""secret["\s]*[:=]\s*["']?[^"'\s]+["']?""", r"""key["\s]*[:=]\s*["']?[A-Za-z0-9\-._~+/]+=*["']?""",
    ]),
    "personalInfo": ("mask", [
        r"""email["\s]*[:=]\s*["']?[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}["']?""",
        r"""phone["\s]*[:=]\s*["']?(\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})["']?""", r"""ssn["\s]*[:=]\s*["']?\d{3}-\d{2}-\d{4}["']?""",
        r"""social[_-]?security["\s]*[:=]\s*["']?\d{3}-\d{2}-\d{4}["']?""", r"""credit[_-]?card["\s]*[:=]\s*["']?\d{4}[-.\s]?\d{4}[-.\s]?\d{4}[-.\s]?\d{4}["']?""",
    ]),
    "financial": ("mask", [
        r"""account[_-]?number["\s]*[:=]\s*["']?\d{4,17}["']?""", r"""routing[_-]?number["\s]*[:=]\s*["']?\d{9}["']?""",
        r"""salary["\s]*[:=]\s*["']?\$\d{1,3}(,\d{3})*(\.\d{2})?["']?""", r"""income["\s]*[:=]\s*["']?\$\d{1,3}(,\d{3})*(\.\d{2})?["']?""",
    ]),
    "businessIds": ("anonymize", [
        r"""employee[_-]?id["\s]*[:=]\s*["']?\d{4,10}["']?""", r"""customer[_-]?id["\s]*[:=]\s*["']?\d{4,10}["']?""", r"""order[_-]?number["\s]*[:=]\s*["']?\d{6,12}["']?""",
        r"""invoice[_-]?number["\s]*[:=]\s*["']?\d{6,12}["']?""",
    ]),
    "medical": ("encrypt", [
        r"""medical[_-]?record["\s]*[:=]\s*["']?\d{6,12}["']?""", r"""health[_-]?insurance["\s]*[:=]\s*["']?\d{6,12}["']?""", r"""diagnosis["\s]*[:=]\s*["']?[A-Z]\d{2}\.\d{1,2}["']?""",
    ]),
    "network": ("mask", [
        r"""ip[_-]?address["\s]*[:=]\s*["']?\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}["']?""", r"""mac[_-]?address["\s]*[:=]\s*["']?([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})["']?""",
        r"""hostname["\s]*[:=]\s*["']?[A-Za-z0-9\-._]+["']?""",
    ]),
}
STACK_TRACE = r"at\s+[^(]+\(([^)]+)\)"
FILE_PATH = r"""["']?[/\\][^"'\s]+[/\\][^"'\s]+["']?"""
#: Log levels whose entries may hold stack traces and paths, and bounds of an entry.
OPEN_LEVELS = ("warn", "error")
LOG_LENGTH, LOG_REDACTIONS = 10_000, 50


def matched(text: Column, patterns: list[str], lower: Column | None = None) -> Column:
    """How many of the patterns are found."""
    return sum((Rx(p, "i").test(text, lower).cast("int") for p in patterns), F.lit(0))


def matches(text: Column, patterns: list[str]) -> Column:
    """How often the patterns are found in all."""
    return lowered(text, lambda t, low: sum((Rx(p, "i").count(t, low) for p in patterns), F.lit(0)))


def highest(found: dict[str, Column]) -> Column:
    """The highest severity among those whose test holds, ``low`` without any."""
    by_level = {s: [t for level, t in found.items() if level.split("/")[0] == s] for s in SEVERITIES}
    tests = [F.when(reduce(lambda a, b: a | b, by_level[s]), s) for s in reversed(SEVERITIES) if by_level[s]]
    return F.coalesce(*tests, F.lit("low"))


def regulated_advice(text: Column) -> Column:
    """``types`` (name and confidence, a third for each pattern found, 1 at most), ``total`` and ``severity``."""

    def result(n: Column) -> Column:
        found = F.filter(F.array(*[F.when(n[k] > 0, F.struct(F.lit(name).alias("type"), F.lit(s).alias("severity"), F.least(n[k] / 3, F.lit(1.0)).alias("confidence"))) for k, (name, (s, _)) in enumerate(ADVICE.items())]), lambda x: x.isNotNull())
        severity = highest({f"{s}/{name}": n[k] > 0 for k, (name, (s, _)) in enumerate(ADVICE.items())})
        return F.struct(found.alias("types"), F.size(found).alias("total"), severity.alias("severity"))

    return let(lowered(text, lambda t, low: F.array(*[matched(t, patterns, low) for _, patterns in ADVICE.values()])), result)


def hierarchy_violations(text: Column) -> Column:
    """``violations`` (names), ``total``, ``severity`` and ``risk``: confidence times the severity's place, summed."""

    def result(n: Column) -> Column:
        each = [(name, s, c, n[k] > 0) for k, (name, (s, c, _)) in enumerate(HIERARCHY.items())]
        found = F.filter(F.array(*[F.when(t, name) for name, _, _, t in each]), lambda x: x.isNotNull())
        risk = sum((F.when(t, c * (SEVERITIES.index(s) + 1)).otherwise(0.0) for _, s, c, t in each), F.lit(0.0))
        return F.struct(found.alias("violations"), F.size(found).alias("total"), highest({f"{s}/{name}": t for name, s, _, t in each}).alias("severity"), risk.alias("risk"))

    return let(lowered(text, lambda t, low: F.array(*[matched(t, patterns, low) for _, _, patterns in HIERARCHY.values()])), result)


def ending(text: Column) -> Column:
    """``categories``, ``severity``, and ``stop`` with the last ``reason`` (a category) to end a stream at once.

    The confidence in a category is its matches for each hundred UTF-16 units, 1 at most.
    """

    def result(n: Column) -> Column:
        each = [(name, s, at_once, n[k]) for k, (name, (s, at_once, _)) in enumerate(ENDINGS.items())]
        found = F.filter(F.array(*[F.when(k > 0, name) for name, _, _, k in each]), lambda x: x.isNotNull())
        stops = [F.when((k > 0) & (k / (tx.length16(text) / 100) >= ENDING_CONFIDENCE), name) for name, _, at_once, k in each if at_once]
        reason = F.coalesce(*reversed(stops))
        return F.struct(found.alias("categories"), highest({f"{s}/{name}": k > 0 for name, s, _, k in each}).alias("severity"), reason.isNotNull().alias("stop"), reason.alias("reason"))

    return let(F.array(*[matches(text, patterns) for _, _, patterns in ENDINGS.values()]), result)


def stream_endings(parts: DataFrame, window_ms: int = ENDING_WINDOW_MS, most_ms: int = ENDING_MS) -> DataFrame:
    """``parts`` (``stream_id, micros, text`` so far) with ``ends``: why a stream should end at this part, null if it need not.

    In order: content, length, duration since the first part, and violations (one for each category of a part) of earlier parts
    in the window.  Parts of the same microsecond do not count each other.  One shuffle on the stream.
    """
    own = W.partitionBy("stream_id")
    before = own.orderBy("micros").rangeBetween(-(window_ms * 1000 - 1), -1)
    rows = parts.withColumn("__e", ending(F.col("text"))).withColumn("__n", F.size("__e.categories"))
    rows = rows.withColumn("__recent", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("__first", F.min("micros").over(own))
    ends = (
        F.when(F.col("__e.stop"), F.col("__e.reason")).when(tx.length16(F.col("text")) > ENDING_LENGTH, "length")
        .when(F.col("micros") - F.col("__first") > most_ms * 1000, "duration").when(F.col("__recent") >= ENDING_VIOLATIONS, "consecutive")
    )
    return rows.withColumn("ends", ends).drop("__e", "__n", "__recent", "__first")


def hedged(text: Column) -> Column:
    return tx.count_hits(F.lower(text), HEDGES) > 0


def unhedged(text: Column, pattern: str, lower: Column | None = None) -> Column:
    """Matches of a claim with no hedging word in the 50 code points before, the match, and the 100 after."""
    rx = Rx(pattern, "i")
    claim, own = rx.java.removeprefix("(?i)"), re.compile(pattern).groups
    # the claim is looked for first: a look-behind tried at every place would cost 51 attempts each
    before = rf"(?i)(?={claim})(?<=(\A(?s:.){{0,{CLAIM_BEFORE - 1}}}|(?s:.){{{CLAIM_BEFORE}}})){claim}"
    after = rf"(?i)(?=({claim}(?s:.){{0,{CLAIM_AFTER}}})){claim}"
    part = [F.regexp_extract_all(text, F.lit(p), g) for p, g in ((before, own + 1), (after, 1))]
    claims = F.zip_with(*part, lambda a, b: F.concat(a, b))
    return F.when(rx.test(text, lower), F.size(F.filter(claims, lambda c: ~hedged(c)))).otherwise(0)


def claims(text: Column) -> dict[str, Column]:
    """How many claims of each kind a text makes."""
    return {kind: matches(text, patterns) for kind, patterns in CLAIMS.items()}


def claim_confidence(text: Column) -> Column:
    """``unhedged`` claims, ``score`` from 0 to 1, and ``risk``."""
    bare = lowered(text, lambda t, low: sum((unhedged(t, p, low) for patterns in CLAIMS.values() for p in patterns), F.lit(0)))

    def result(n: Column) -> Column:
        specific = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in SPECIFIC])
        score = F.lit(1.0) - n[0] * F.lit(0.15) - n[1] * F.lit(0.2) - n[2] * F.lit(0.1) - F.when(specific, 0.2).otherwise(0.0) + F.when(hedged(text), 0.1).otherwise(0.0)
        bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
        return let(bounded, lambda s: F.struct(n[0].alias("unhedged"), s.alias("score"), F.when(s >= 0.8, "low").when(s >= 0.6, "medium").when(s >= 0.4, "high").otherwise("critical").alias("risk")))

    return let(F.array(bare, matches(text, CLAIMS["citationRequired"] + CLAIMS["currentEvents"]), matches(text, CLAIMS["numericalClaims"])), result)


def each_match(rx: Rx, change: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A function of a text: every match replaced by what ``change`` makes of it."""

    def changed(text: Column) -> Column:
        pieces, found = F.split(text, rx.java, -1), F.transform(rx.all(text), change)
        return F.array_join(F.zip_with(pieces, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return changed


def masked(match: Column) -> Column:
    n = F.length(match)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(match, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(match, F.lit(2))))


def hashed(match: Column) -> Column:
    """The absolute value of the 31-based polynomial of the characters in 32 signed bits, in eight hexadecimal digits."""
    h = F.aggregate(F.split(match, ""), F.lit(0).cast("bigint"), lambda a, c: F.pmod(a * 31 + F.ascii(c), F.lit(1 << 32)))
    return let(h, lambda v: F.concat(F.lit("HASH_"), F.lpad(F.lower(F.hex(F.least(v, F.lit(1 << 32) - v))), 8, "0")))


def encoded(match: Column) -> Column:
    """The first 20 digits in base 64, as specified: no encryption."""
    return F.concat(F.lit("ENCRYPTED_"), F.left(F.base64(match.cast("binary")), F.lit(20)))


def log_counts(entry: Column) -> dict[str, Column]:
    """Sensitive parts of a log entry by kind."""
    return {kind: matches(entry, patterns) for kind, (_, patterns) in LOG_DATA.items()}


def redacted_logs(rows: DataFrame, entry: str, out: str = "redacted") -> DataFrame:
    """``rows`` with the log entries redacted: sensitive parts hashed, removed, masked, anonymized or encoded, kind after kind.

    Patterns that the entry itself lacks are passed over.  A projection for each pattern: one expression of them all
    would use the text of the step before several times, and double at every step.  No shuffle.
    """
    rows = rows.withColumn(out, F.col(entry))
    for kind, (strategy, patterns) in LOG_DATA.items():
        tag = f"[{kind.upper()}_ANONYMIZED]"
        for p in patterns:
            rx, now = Rx(p, "i"), F.col(out)
            if strategy in ("remove", "anonymize"):
                changed = rx.replace(now, "[REMOVED]" if strategy == "remove" else tag)
            else:
                changed = each_match(rx, {"hash": hashed, "mask": masked, "encrypt": encoded}[strategy])(now)
            rows = rows.withColumn(out, F.when(rx.test(F.col(entry)), changed).otherwise(now))
    return rows


def log_compliance(entry: Column, level: str = "info") -> Column:
    """``violations`` of a log entry, and how compliant it is."""
    closed = F.lit(level not in OPEN_LEVELS)

    def result(n: Column) -> Column:
        long = tx.length16(entry) > LOG_LENGTH
        found = F.filter(F.array(
            F.when(long, F.concat(F.lit("Log entry too long: "), tx.length16(entry).cast("string"), F.lit(" characters"))),
            F.when(n > 0, F.concat(F.lit("Sensitive data detected: "), n.cast("string"), F.lit(" items"))),
            F.when(closed & Rx(STACK_TRACE).test(entry), "Stack traces not allowed for this log level"), F.when(closed & Rx(FILE_PATH).test(entry), "File paths not allowed for this log level"),
        ), lambda x: x.isNotNull())
        return F.struct(found.alias("violations"), F.when(n > LOG_REDACTIONS, "low").when((n > 0) | long, "medium").otherwise("high").alias("compliance"))

    return let(sum(log_counts(entry).values(), F.lit(0)), result)
