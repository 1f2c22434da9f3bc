"""Checks of prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bulwark.functions import text as tx
from bulwark.functions.normalize import Normalization, normalize
from bulwark.functions.regex import Rx, literal
from bulwark.functions.result import let, lowered, result
from bulwark.operators.check import Check, Scope

#: Personal data in prompts.
PII = {
    "email": Rx(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    "phone": Rx(r"\b(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b"),
    "ssn": Rx(r"\b\d{3}-\d{2}-\d{4}\b"),
    "creditCard": Rx(r"\b(?:\d{4}[\s-]?){3}\d{4}\b"),
    "ipAddress": Rx(r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"),
}
#: Words by category of profanity, with the category's severity.
PROFANITY = {"mild": ("medium", ["damn", "hell", "crap"]), "strong": ("high", ["profanity1", "profanity2"]), "extreme": ("critical", ["extreme1", "extreme2"])}
#: Toxic words in prompts.
TOXIC = ["hate", "kill", "die", "stupid", "idiot", "moron", "toxic", "harmful"]
#: Signs of homework, and contexts that excuse them.
MATH_WORDS = ["solve", "calculate", "equation", "homework", "assignment", "problem set"]
MATH_PATTERNS = [
    Rx(r"\b\d+\s*[+\-*/]\s*\d+"),
    Rx(r"\b[xy]\s*[+\-*/=]\s*\d+"),
    Rx(r"\b(derivative|integral|limit|theorem|proof)", "i"),
    Rx(r"find\s+the\s+(value|solution|answer)", "i"),
]
EDUCATION = ["learning", "teaching", "education", "tutorial", "explanation", "concept", "theory", "understanding", "study", "research"]
#: Names of languages and what they are short for.
LANGUAGE_ALIASES = {
    "javascript": "javascript", "js": "javascript", "node": "javascript", "react": "javascript", "angular": "javascript", "vue": "javascript",
    "python": "python", "py": "python", "django": "python", "flask": "python", "pandas": "python",
    "java": "java", "spring": "java", "hibernate": "java",
    "c++": "cpp", "cpp": "cpp", "c plus plus": "cpp", "cplusplus": "cpp",
    "c#": "csharp", "csharp": "csharp", "dotnet": "csharp", "asp.net": "csharp", "aspnet": "csharp",
    "php": "php", "laravel": "php", "symfony": "php", "ruby": "ruby", "rails": "ruby", "gem": "ruby", "go": "go", "golang": "go",
    "rust": "rust", "cargo": "rust", "sql": "sql", "mysql": "sql", "postgresql": "sql", "oracle": "sql",
    "typescript": "typescript", "ts": "typescript", "html": "html", "css": "css", "scss": "css", "sass": "css",
}
#: Requests for code, and the words by which a language is known.
CODE_WORDS = ["write code", "generate code", "create function", "implement", "script", "code example", "show me code", "write a function", "create a class"]
LANGUAGES = {
    "javascript": r"\b(javascript|js|node|react|angular|vue|typescript|ts)\b", "python": r"\b(python|py|django|flask|pandas)\b",
    "java": r"\b(java|spring|hibernate)\b", "cpp": r"\b(c\+\+|cpp|c plus plus|cplusplus)\b", "csharp": r"\b(c#|csharp|dotnet|asp\.net|aspnet)\b",
    "php": r"\b(php|laravel|symfony)\b", "ruby": r"\b(ruby|rails|gem)\b", "go": r"\b(golang|go)\b", "rust": r"\b(rust|cargo)\b",
    "sql": r"\b(sql|mysql|postgresql|oracle)\b", "html": r"\b(html|htm)\b", "css": r"\b(css|scss|sass)\b",
}
#: Prompt injections and their weights.
INJECTIONS = [
    (Rx(r"ignore\s+previous\s+instructions", "i"), 0.9),
    (Rx(r"system\s*:\s*you\s+are\s+now", "i"), 0.8),
    (Rx(r"forget\s+everything\s+above", "i"), 0.9),
    (Rx(r"\bDAN\b.*mode", "i"), 0.7),
    (Rx(r"jailbreak", "i"), 0.8),
    (Rx(r"act\s+as\s+if\s+you\s+are", "i"), 0.6),
    (Rx(r"pretend\s+to\s+be", "i"), 0.6),
    (Rx(r"role\s*:\s*system", "i"), 0.7),
    (Rx(r"\boverride\s+system\s+prompt\b", "i"), 0.9),
    (Rx(r"\bignore\s+all\s+previous\s+instructions\b", "i"), 0.9),
    (Rx(r"\bnew\s+instructions\s*:\s*", "i"), 0.8),
    (Rx(r"\bact\s+as\s+a\s+different\s+ai\b", "i"), 0.7),
    (Rx(r"\bchain\s+of\s+thought\s+baiting", "i"), 0.6),
    (Rx(r"\bfile\s+system\s+override", "i"), 0.8),
    (Rx(r"(?:call|use|invoke|execute)\s+(?:the\s+)?(?:[\w.-]+\s+)?(?:mcp|tool|function)", "i"), 0.8),
    (Rx(r"mcp\s*:\s*(?:ignore|override|bypass)", "i"), 0.9),
    (Rx(r"tool\s+response\s*:\s*(?:ignore|system|admin)", "i"), 0.85),
    (Rx(r"(?:from|via)\s+mcp.*?(?:ignore|forget|override)", "i"), 0.8),
    (Rx(r"server\s+says?\s*:\s*(?:ignore|override|system)", "i"), 0.85),
    (Rx(r"(?:after|then)\s+(?:calling|using)\s+(?:the\s+)?(?:[\w.-]+\s+)?(?:tool|mcp)", "i"), 0.7),
    (Rx(r"\btool\s+output\s*:\s*(?:system|admin|root)", "i"), 0.8),
    (Rx(r"contextual\s+(?:override|injection|manipulation)", "i"), 0.9),
    (Rx(r"(?:cascade|chain|sequence)\s+(?:attack|injection|exploit)", "i"), 0.85),
    (Rx(r"\bhidden\s+in\s+(?:response|output|result)", "i"), 0.7),
    (Rx(r"169\.254\.169\.254"), 0.9),
    (Rx(r"\/etc\/(?:passwd|shadow)\b"), 0.9),
    (Rx(r"~\/\.ssh\/(?:id_rsa|authorized_keys)"), 0.9),
    (Rx(r"\$\((?:whoami|hostname|printenv|cat\s)", "i"), 0.85),
    (Rx(r"\/dev\/tcp\/"), 0.85),
    (Rx(r"\[\s*mcp\s+context\s+update\s*\]", "i"), 0.85),
    (Rx(r"\.cursorrules\s+file\s+says", "i"), 0.8),
    (Rx(r"<\|(?:im_start|im_end|system|end|endoftext)\|>", "i"), 0.85),
    (Rx(r"\[\/?INST\]", "i"), 0.8),
    (Rx(r"<<\/?SYS>>", "i"), 0.85),
    (Rx(r"```\s*system\b", "i"), 0.8),
    (Rx(r"###\s*(?:system|instruction|human|assistant)\s*:", "i"), 0.75),
]


def length_limit(limit: int, method: str = "characters", severity: str = "medium") -> Check:
    """Triggers above ``limit`` characters (UTF-16), bytes or words."""
    measure = {"characters": tx.length16, "bytes": tx.count_bytes, "words": tx.count_words}[method]

    def build(s: Scope) -> Column:
        return let(measure(s.text), lambda n: result("input-length-limit", n > limit, severity, F.concat(F.lit("Input "), n.cast("string"), F.lit(f" exceeds limit of {limit}")), "Please shorten your input", count=n, limit=limit, method=method))

    return Check("input-length-limit", build)


def first_hit(tests: list[tuple[Column, tuple[str, ...]]], names: tuple[str, ...]) -> Column:
    """The labels of the first test that holds, as a struct; null if none does."""
    out = F.lit(None)
    for test, labels in reversed(tests):
        out = F.when(test, F.struct(*[F.lit(v).alias(n) for n, v in zip(names, labels, strict=True)])).otherwise(out)
    return out


def word_test(text: Column, lower: Column, word: str, boundaries: bool) -> Column:
    return tx.word_boundary(word).test(text, lower) if boundaries else Rx(literal(word), "i").test(text, lower)


def blocked_words(words: list[str], allowed: list[str] = (), boundaries: bool = True, severity: str = "high") -> Check:
    """The first blocked word, unless an allowed phrase stands in the text."""

    def build(s: Scope) -> Column:
        hit = lowered(s.text, lambda t, low: first_hit([(word_test(t, low, w, boundaries), (w,)) for w in words], ("word",)))["word"]
        free = tx.count_hits(s.lower, [a.lower() for a in allowed]) > 0 if allowed else F.lit(False)
        found = F.struct(hit.alias("hit"), free.alias("free"))
        return let(found, lambda f: result("blocked-words", f["hit"].isNotNull() & ~f["free"], severity, F.concat(F.lit("Blocked word detected: "), f["hit"]), word=F.when(~f["free"], f["hit"])))

    return Check("blocked-words", build)


def blocked_keywords(words: list[str]) -> Check:
    """Blocked words without boundaries."""
    return blocked_words(words, boundaries=False)


def profanity_filter(categories: dict[str, tuple[str, list[str]]] | None = None, custom: list[str] = (), boundaries: bool = True) -> Check:
    """The first word of the category lists, then of the custom list."""
    lists = [(w, c, sev) for c, (sev, ws) in (PROFANITY if categories is None else categories).items() for w in ws] + [(w, "custom", "high") for w in custom]

    def build(s: Scope) -> Column:
        hit = lowered(s.text, lambda t, low: first_hit([(word_test(t, low, w, boundaries), (w, c, sev)) for w, c, sev in lists], ("word", "category", "severity")))
        return let(hit, lambda h: result("profanity-filter", h.isNotNull(), F.coalesce(h["severity"], F.lit("medium")), F.concat(F.lit("Inappropriate language detected: "), h["category"]), word=h["word"], category=h["category"]))

    return Check("profanity-filter", build)


def custom_validation(name: str, valid, message: str = "Validation failed", severity: str = "medium") -> Check:
    """Triggers when the user's predicate on the scope does not hold."""
    return Check(name, lambda s: result(name, ~F.coalesce(valid(s), F.lit(False)), severity, message))


def injection_detector(threshold: float = 0.5, normalization: bool | dict | Normalization = True) -> Check:
    """Mean weight of the injection patterns that the raw or the normalized text matches."""

    def scored(raw: Column, lower: Column, clean: Column | None) -> Column:
        hits = []
        for rx, _ in INJECTIONS:
            hits.append(rx.test(raw, lower) if clean is None else rx.test(clean, clean) | rx.test(raw, lower))
        return F.array(*hits)

    def summed(hits: Column) -> Column:
        count, total, sources = F.lit(0), F.lit(0.0), []
        for k, (rx, weight) in enumerate(INJECTIONS):
            count, total = count + hits[k].cast("int"), total + F.when(hits[k], weight).otherwise(0.0)
            sources.append(F.when(hits[k], F.lit(rx.source)))
        return F.struct(count.alias("n"), total.alias("w"), F.concat_ws("\n", *sources).alias("sources"))

    def judged(found: Column) -> Column:
        count = found["n"]
        confidence = F.when(count > 0, F.least(found["w"] / count, F.lit(1.0))).otherwise(0.0)
        return result(
            "prompt-injection-detector", confidence > threshold, F.when(confidence > 0.8, "critical").otherwise("high"),
            F.format_string("Potential prompt injection detected (confidence: %.1f%%): %d suspicious patterns found", confidence * 100, count),
            "Please rephrase your request without system instructions or role-playing elements", confidence,
            patterns=count, threshold=threshold, sources=found["sources"],
        )

    def build(s: Scope) -> Column:
        if normalization is False:
            both = F.struct(s.text.alias("raw"), s.lower.alias("lower"))
            return let(let(let(both, lambda t: scored(t["raw"], t["lower"], None)), summed), judged)
        both = F.struct(s.text.alias("raw"), s.lower.alias("lower"), normalize(s.text, normalization).alias("clean"))
        return let(let(let(both, lambda t: scored(t["raw"], t["lower"], t["clean"])), summed), judged)

    return Check("prompt-injection-detector", build, "critical")


def high_entropy(threshold: float = 4.5, min_length: int = 40, severity: str = "medium") -> Check:
    """Texts of ``min_length`` or more whose characters carry ``threshold`` bits or more."""

    def build(s: Scope) -> Column:
        bits = F.when(tx.length16(s.text) >= min_length, tx.entropy(s.text))
        return result("high-entropy-detector", bits >= threshold, severity, "High-entropy content detected", entropy=bits, threshold=threshold)

    return Check("high-entropy-detector", build)


def pii_matches(text: Column) -> dict[str, Column]:
    """Valid matches by kind."""
    found = {k: rx.all(text) for k, rx in PII.items()}
    found["creditCard"] = F.filter(found["creditCard"], tx.luhn)
    found["email"] = F.filter(found["email"], lambda m: ~F.contains(m, F.lit("http")))
    return found


def pii_detector() -> Check:
    """Personal data of five kinds; cards must pass the Luhn check."""

    def build(s: Scope) -> Column:
        found = pii_matches(s.text)
        total, parts, masked = F.lit(0), [], []
        for kind, got in found.items():
            n = F.size(got)
            total = total + n
            parts.append(F.when(n > 0, F.concat(F.lit(f"{kind} ("), n.cast("string"), F.lit(")"))))
            masked.append(F.when(n > 0, F.concat(F.lit(f"{kind}="), F.array_join(masked_all(got, kind), ","))))
        summary = F.concat_ws(", ", *parts)
        return result("pii-detector", total > 0, "critical", F.concat(F.lit("PII detected: "), summary), "Please remove any personal information from your input", types=summary, total_matches=total, masked=F.concat_ws(";", *masked))

    return Check("pii-detector", build, "critical")


def masked_all(values: Column, kind: str) -> Column:
    return F.transform(values, lambda m: tx.mask(m, kind))


def toxicity_detector(threshold: float = 0.7) -> Check:
    """0.3 for each toxic word that occurs anywhere."""

    def build(s: Scope) -> Column:
        def judged(n: Column) -> Column:
            score = n * F.lit(0.3)
            return result("toxicity-detector", score > threshold, F.when(score > 0.8, "critical").otherwise("high"), "Toxic content detected", confidence=score, words=n, threshold=threshold)

        return let(tx.count_hits(s.lower, TOXIC), judged)

    return Check("toxicity-detector", build, "high")


def math_homework(enabled: bool = False, strict: bool = False, allowed: list[str] = (), severity: str = "medium") -> Check:
    """Two homework words or (``strict``: and) a formula, outside educational contexts; off unless enabled."""

    def build(s: Scope) -> Column:
        excused = tx.count_hits(s.lower, EDUCATION + [a.lower() for a in allowed]) > 0
        words = tx.count_hits(s.lower, MATH_WORDS)
        formulas = F.lit(0)
        for rx in MATH_PATTERNS:
            formulas = formulas + rx.test(s.text).cast("int")
        asked = (words >= 2) & (formulas > 0) if strict else (words >= 2) | (formulas > 0)
        return result("math-homework-detector", F.lit(enabled) & ~excused & asked, severity, "Math homework request detected", words=words, formulas=formulas, excused=excused)

    return Check("math-homework-detector", build)


def code_languages(text: Column) -> Column:
    return lowered(text, lambda t, low: tx.which({name: Rx(p, "i").test(t, low) for name, p in LANGUAGES.items()}))


def code_limiter(allowed: list[str] | None = None, denied: list[str] | None = None, mode: str = "allow-only", severity: str = "medium") -> Check:
    """Requests for code in a language that is denied, or (``allow-only``) not allowed."""

    def build(s: Scope) -> Column:
        listed = F.array(*map(F.lit, (denied if mode == "deny" else allowed) or [])).cast("array<string>")

        def judged(f: Column) -> Column:
            asked, found = f["asked"], f["found"]
            blocked = F.array_intersect(found, listed) if mode == "deny" else F.array_except(found, listed)
            return result("code-generation-limiter", asked & (F.size(blocked) > 0), severity, "Code generation not allowed", languages=F.array_join(found, ","), blocked=F.when(asked, F.array_join(blocked, ",")), mode=mode)

        return let(F.struct((tx.count_hits(s.lower, CODE_WORDS) > 0).alias("asked"), code_languages(s.text).alias("found")), judged)

    return Check("code-generation-limiter", build)


def language_name(name: str) -> str:
    """A language by its common name."""
    return LANGUAGE_ALIASES.get(name.lower(), name.lower())


def allowed_tools(allowed: list[str], denied: list[str] = ()) -> Check:
    """Tool calls outside the allow list or on the deny list."""
    if not allowed:
        raise ValueError("an allow list is needed")

    def build(s: Scope) -> Column:
        bad = F.array_intersect(s.tools, F.array(*map(F.lit, denied)).cast("array<string>"))
        unknown = F.array_except(F.array_except(s.tools, F.array(*map(F.lit, allowed))), bad)
        every = F.concat(bad, unknown)
        return result("allowed-tools", F.size(every) > 0, F.when(F.size(bad) > 0, "critical").otherwise("high"), F.concat(F.lit("Tool not allowed: "), F.array_join(every, ", ")), denied=F.array_join(bad, ","), unknown=F.array_join(unknown, ","))

    return Check("allowed-tools", build, "high")
