"""Scores of categories of patterns, as the worked examples combine them."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.functions import text as tx
from bulwark.functions.regex import GAP, Rx
from bulwark.functions.result import let, lowered

_LANGUAGES = "french|spanish|german|italian|portuguese|dutch|russian|chinese|japanese|korean"
_SECRET = "(prompt|instructions?|system.*message)"
#: Categories of injection with weights.
INJECTION = {
    "roleConfusion": (8, [
        "ignore.*previous.*instructions?", "forget.*previous.*instructions?", "disregard.*previous.*instructions?", "ignore.*above.*instructions?", "forget.*above.*instructions?",
        "disregard.*above.*instructions?", "ignore.*system.*prompt", "forget.*system.*prompt", "disregard.*system.*prompt", "ignore.*your.*instructions?", "forget.*your.*instructions?",
        "disregard.*your.*instructions?",
    ]),
    "systemOverride": (10, [
        "system.*prompt.*override", "override.*system.*prompt", "new.*system.*prompt", "system.*message.*override", "override.*system.*message", "new.*system.*message",
        "system.*instruction.*override", "override.*system.*instruction", "new.*system.*instruction",
    ]),
    "jailbreak": (12, [
        "you.*are.*now.*(dan|do.*anything.*now)", "pretend.*to.*be.*(dan|do.*anything.*now)", "act.*as.*(dan|do.*anything.*now)", "roleplay.*as.*(dan|do.*anything.*now)",
        "you.*are.*(dan|do.*anything.*now)", "from.*now.*on.*you.*are.*(dan|do.*anything.*now)", "ignore.*safety.*measures", "bypass.*safety.*measures", "disable.*safety.*measures",
        "ignore.*content.*policy", "bypass.*content.*policy", "disable.*content.*policy",
    ]),
    "translationBypass": (6, [f"translate.*this.*to.*({_LANGUAGES})", f"convert.*this.*to.*({_LANGUAGES})", f"in.*({_LANGUAGES}).*say", f"say.*in.*({_LANGUAGES})"]),
    "codeInjection": (15, ["execute.*this.*code", "run.*this.*code", "eval.*this.*code", "interpret.*this.*code", "process.*this.*code"]),
    "dataExfiltration": (9, [
        f"show.*me.*your.*{_SECRET}", f"what.*are.*your.*{_SECRET}", f"repeat.*your.*{_SECRET}", f"echo.*your.*{_SECRET}", f"output.*your.*{_SECRET}", f"print.*your.*{_SECRET}",
        f"display.*your.*{_SECRET}",
    ]),
    "contextManipulation": (5, [
        "clear.*context", "reset.*context", "start.*over", "begin.*anew", "new.*conversation", "fresh.*start", "ignore.*context", "forget.*context", "disregard.*context",
    ]),
}
#: Words that count apart from the categories.
INJECTION_WORDS = [
    "override", "ignore", "forget", "disregard", "bypass", "disable", "jailbreak", "dan", "do anything now", "system prompt", "system message", "system instruction",
    "safety measures", "content policy", "execute", "eval", "run code", "interpret code",
]
#: Weights and patterns of jailbreak attempts, and words that count apart from them.
JAILBREAK = {
    "danStyle": (15, [
        "you.*are.*now.*dan", "you.*are.*now.*do.*anything.*now", "pretend.*to.*be.*dan", "act.*as.*dan", "roleplay.*as.*dan", r"you.*are.*dan.*\(do.*anything.*now\)",
        "from.*now.*on.*you.*are.*dan", "ignore.*all.*previous.*instructions.*you.*are.*now.*dan", "you.*are.*now.*a.*new.*ai.*called.*dan", "dan.*mode.*activated",
        "switch.*to.*dan.*mode", "enter.*dan.*mode",
    ]),
    "translationBypass": (8, [
        "translate.*this.*to.*(french|spanish|german|italian|portuguese|dutch|russian|chinese|japanese|korean|arabic)", "translate.*this.*to.*hindi", "convert.*this.*to.*(french|spanish|german|italian|portuguese|dutch|russian|chinese|japanese|korean|arabic|hindi)",
        "in.*(french|spanish|german|italian|portuguese|dutch|russian|chinese|japanese|korean|arabic|hindi).*say", "say.*in.*(french|spanish|german|italian|portuguese|dutch|russian|chinese|japanese|korean|arabic|hindi)", "respond.*in.*(french|spanish|german|italian|portuguese|dutch|russian|chinese|japanese|korean|arabic|hindi)", "answer.*in.*(french|spanish|german|italian|portuguese|dutch|russian|chinese|japanese|korean|arabic|hindi)",
    ]),
    "roleplayCoercion": (12, [
        "pretend.*to.*be.*(a|an).*[^.]*who.*can.*do.*anything", "act.*as.*(a|an).*[^.]*who.*ignores.*rules", "roleplay.*as.*(a|an).*[^.]*who.*bypasses.*safety",
        "you.*are.*(a|an).*[^.]*who.*doesn.*t.*follow.*rules", "imagine.*you.*are.*(a|an).*[^.]*who.*can.*break.*rules", "suppose.*you.*are.*(a|an).*[^.]*who.*ignores.*policies",
    ]),
    "safetyBypass": (10, [
        "ignore.*safety.*measures", "bypass.*safety.*measures", "disable.*safety.*measures", "turn.*off.*safety.*measures", "ignore.*content.*policy", "bypass.*content.*policy",
        "disable.*content.*policy", "ignore.*ethical.*guidelines", "bypass.*ethical.*guidelines", "ignore.*moral.*constraints", "bypass.*moral.*constraints",
    ]),
    "systemManipulation": (14, [
        "new.*system.*prompt", "override.*system.*prompt", "replace.*system.*prompt", "change.*system.*prompt", "modify.*system.*prompt", "update.*system.*prompt",
        "new.*instructions", "override.*instructions", "replace.*instructions",
    ]),
    "characterMode": (6, ["character.*mode", "persona.*mode", "role.*mode", "switch.*to.*character", "become.*a.*character", "adopt.*a.*persona"]),
    "hypotheticalAbuse": (7, [
        "hypothetically.*if.*you.*could.*do.*anything", "imagine.*if.*you.*were.*not.*bound.*by.*rules", "suppose.*you.*could.*ignore.*all.*restrictions",
        "what.*if.*you.*didn.*t.*have.*to.*follow.*rules", "if.*you.*were.*free.*to.*do.*anything",
    ]),
    "codeExecution": (13, ["execute.*this.*code", "run.*this.*code", "eval.*this.*code", "interpret.*this.*code", "process.*this.*code", "execute.*the.*following", "run.*the.*following"]),
    "developerMode": (11, ["developer.*mode", "debug.*mode", "admin.*mode", "root.*mode", "privileged.*mode", "unrestricted.*mode"]),
}
JAILBREAK_WORDS = [
    "jailbreak", "dan", "do anything now", "ignore rules", "bypass", "override", "disable", "unrestricted", "unlimited", "no limits", "no restrictions", "ignore safety",
    "ignore ethics", "ignore morals", "ignore guidelines", "ignore policies", "ignore constraints", "ignore boundaries", "ignore filters", "ignore content",
]
#: Pairs of words that together weigh so much.
JAILBREAK_PAIRS = [("ignore", "previous", 5), ("new", "system", 8), ("hypothetically", "could", 4)]
#: Topics and their keywords, in the order they are tried.
TOPICS = {
    "technology": ["ai", "computer", "software", "technology", "digital", "internet", "algorithm"],
    "science": ["science", "research", "experiment", "theory", "hypothesis", "discovery"],
    "health": ["health", "medical", "disease", "treatment", "medicine", "doctor", "patient"],
    "business": ["business", "company", "market", "economy", "finance", "investment", "profit"],
    "history": ["history", "historical", "past", "ancient", "century", "war", "civilization"],
    "environment": ["environment", "climate", "nature", "pollution", "ecosystem", "sustainability"],
}
#: Answers that help nobody.
GENERIC = ["i can't help", "i don't know", "i'm sorry, but", "i cannot provide", "i'm not able to"]


def level(score: Column, critical: float, high: float, medium: float) -> Column:
    return F.when(score >= critical, "critical").when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def category_score(text: Column, lower: Column, categories: dict[str, tuple[int, list[str]]], words: list[str], per_word: int, each: bool = False) -> Column:
    """Weights of the categories found (``each``: of every pattern found), and so much for each word."""
    total = tx.count_hits(lower, words) * per_word
    for weight, patterns in categories.values():
        found = [Rx(p, "i").test(text, lower) for p in patterns]
        total = total + weight * (sum((f.cast("int") for f in found), F.lit(0)) if each else reduce(Column.__or__, found).cast("int"))
    return total


def injection_score(text: Column) -> Column:
    """``score`` and ``risk`` of a prompt, by category, keyword and a few combinations."""

    def scored(t: Column, lower: Column) -> Column:
        score = category_score(t, lower, INJECTION, INJECTION_WORDS, 2)
        blocks = Rx(r"```.*\n.*```", "s").test(t) | Rx(r"<script.*>.*<\/script>", "is").test(t, lower)
        named = reduce(Column.__or__, [Rx(p, "i").test(t, lower) for p in INJECTION["codeInjection"][1]])
        score = score + F.when(blocks & ~named, INJECTION["codeInjection"][0]).otherwise(0)
        score = score + F.when(F.contains(t, F.lit("```")) & F.contains(t, F.lit("system")), 5).otherwise(0)
        return score + F.when(F.contains(t, F.lit("<script")) | F.contains(t, F.lit("javascript:")), 8).otherwise(0)

    return let(lowered(text, scored), lambda s: F.struct(s.alias("score"), level(s, 20, 15, 10).alias("risk")))


def jailbreak_score(text: Column) -> Column:
    """``score`` and ``risk`` of a prompt: every pattern found weighs what its category does, then words and pairs of words."""

    def scored(t: Column, lower: Column) -> Column:
        score = category_score(t, lower, JAILBREAK, JAILBREAK_WORDS, 3, each=True)
        for a, b, weight in JAILBREAK_PAIRS:
            score = score + F.when(F.contains(t, F.lit(a)) & F.contains(t, F.lit(b)), weight).otherwise(0)
        return score

    return let(lowered(text, scored), lambda s: F.struct(s.alias("score"), level(s, 25, 18, 10).alias("risk")))


def topic(text: Column) -> Column:
    """The first topic with a keyword in the text."""
    lower = F.lower(text)
    return F.coalesce(*[F.when(tx.count_hits(lower, words) > 0, F.lit(t)) for t, words in TOPICS.items()], F.lit("general"))


def quality_issues(text: Column) -> Column:
    """What is wrong with an answer, in order."""
    sentences = F.filter(F.split(text, "[.!?]+"), lambda s: tx.trim(s) != "")
    distinct = F.size(F.array_distinct(F.transform(sentences, lambda s: F.lower(tx.trim(s)))))
    questions = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    empty = F.exists(Rx(r"```[\s\S]*?```").all(text), lambda b: tx.trim(F.regexp_replace(b, "```[0-9A-Za-z_]*", "")) == "")
    return F.filter(F.array(
        F.when(tx.length16(text) < 20, "Response too short"), F.when(tx.count_hits(F.lower(text), GENERIC) > 0, "Generic/unhelpful response"),
        F.when((F.size(sentences) > 2) & (distinct / F.size(sentences) < 0.7), "Repetitive content"), F.when(questions > 3, F.concat(F.lit("Too many questions ("), questions.cast("string"), F.lit(")"))),
        F.when(Rx(r"[^.!?]\s*$").test(tx.trim(text)), "Incomplete sentence"), F.when(empty, "Empty code block"),
    ), lambda x: x.isNotNull())


def similarity(a: Column, b: Column) -> Column:
    """Words in common over all words, as sets."""
    return let(F.struct(word_set(a).alias("x"), word_set(b).alias("y")), lambda p: set_similarity(p["x"], p["y"]))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), f"{GAP}+"))


def set_similarity(x: Column, y: Column) -> Column:
    """Elements in common over all elements, of arrays without repeats."""
    return let(F.size(F.array_intersect(x, y)), lambda n: n / (F.size(x) + F.size(y) - n))


#: So many of the commonest words are put last where pairs are looked for by rare words.
COMMONEST = 256
#: Sets up to this size are compared word by word, as ``array_intersect`` builds a hash set for each pair.
FEW = 4


def word_codes(words: DataFrame) -> tuple[Callable[[Column], Column], list[int]]:
    """A hash that tells all words of ``word`` apart, and the codes of the commonest, rarest of them first.

    A seed under which two words share a code is given up for the next, so equal codes are equal words.
    """
    counts = words.groupBy("word").count()
    for seed in itertools.count():
        code = lambda w: F.xxhash64(F.lit(seed), w)  # noqa: B023, E731
        codes = counts.groupBy(code(F.col("word")).alias("code")).agg(F.count("*").alias("words"), F.sum("count").alias("rows"))
        top = codes.orderBy(F.desc(F.col("words") > 1), F.desc("rows"), "code").limit(COMMONEST).collect()
        if not top or top[0]["words"] == 1:
            return code, [r["code"] for r in reversed(top)]


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is evaluated once a row: no later filter or column inlines what a generator made."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def common_words(a: Column, b: Column) -> Column:
    """How many elements two arrays of codes without repeats share."""
    one_by_one = reduce(lambda n, i: n + F.when(F.array_contains(b, F.get(a, F.lit(i))), 1).otherwise(0), range(FEW), F.lit(0))
    return F.when(F.size(a) <= FEW, one_by_one).otherwise(F.size(F.array_intersect(a, b)))


def inconsistent_pairs(answers: DataFrame, seconds: int = 3600, prompts_above: float = 0.8, answers_below: float = 0.3) -> DataFrame:
    """Pairs of ``id, topic, micros, prompt, answer`` close in time on one topic: like prompts with unlike answers.

    An interval join made an equi-join on topic, time bucket and a rare word of the prompt: a row meets the rows of its own bucket and the one
    before. Of ``n`` words more than a share ``t`` must be common, so two like prompts have their first common word, in any one order of all words,
    among the first ``n - floor(t * n)`` of each; rare words come first. Texts are made codes of words once a row, before the join, and what a pair
    has in common is counted once a pair, prompts first.
    """
    width = seconds * 1_000_000
    sets = answers.select("id", "topic", "micros", word_set(F.col("prompt")).alias("prompt"), word_set(F.col("answer")).alias("answer"))
    code, common = word_codes(sets.select(F.explode(F.concat("prompt", "answer")).alias("word")))
    last = F.array(*map(F.lit, common)).cast("array<bigint>")
    ordered = F.transform(F.array_sort(F.transform("prompt", lambda w: F.struct(F.array_position(last, code(w)).alias("place"), code(w).alias("code")))), lambda x: x["code"])
    first = lambda c: F.slice(c, 1, (F.size(c) - F.floor(F.size(c) * prompts_above - 1e-9)).cast("int"))
    meets = F.explode(F.array(F.lit(0).cast("bigint")) if prompts_above < 0 else first("prompt")).alias("key")

    rows = sets.select("id", "topic", "micros", ordered.alias("prompt"), F.transform("answer", code).alias("answer"), F.floor(F.col("micros") / width).alias("bucket")).select("*", meets)
    late = rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns])
    early = rows.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)))
    near = (F.col("topic") == F.col("b_topic")) & (F.col("bucket") == F.col("b_bucket")) & (F.col("key") == F.col("b_key"))
    order = (F.col("micros") <= F.col("b_micros")) & (F.col("b_micros") - F.col("micros") <= width) & ((F.col("micros") < F.col("b_micros")) | (F.col("id") < F.col("b_id")))
    share = lambda c: F.col(f"{c}_common") / (F.size(c) + F.size(f"b_{c}") - F.col(f"{c}_common"))
    # merged, never broadcast: a few rows make many pairs, and a small table's scan is a single task
    pairs = early.join(late.hint("merge"), near & order)
    same = F.when(F.col("prompt") == F.col("b_prompt"), F.size("prompt")).otherwise(common_words(F.col("prompt"), F.col("b_prompt")))
    pairs = bound(pairs, "prompt_common", same).withColumn("prompt_similarity", share("prompt")).filter(F.col("prompt_similarity") > prompts_above)
    if prompts_above >= 0:  # a pair that meets at several words counts at the first
        single = (F.size(first("prompt")) == 1) | (F.size(first("b_prompt")) == 1)
        pairs = pairs.filter(single | (F.col("key") == F.get(F.array_intersect(first("prompt"), first("b_prompt")), F.lit(0))))
    pairs = bound(pairs, "answer_common", common_words(F.col("answer"), F.col("b_answer"))).withColumn("answer_similarity", share("answer")).filter(F.col("answer_similarity") < answers_below)
    return pairs.select(F.col("id").alias("a"), F.col("b_id").alias("b"), "topic", "prompt_similarity", "answer_similarity")


def url_issues(url: Column, allowed: list[str], extensions: list[str] = ("exe", "bat", "sh", "dll"), ports: list[int] = (80, 443)) -> Column:
    """What a browsing policy holds against a URL."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    port = F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*?:(\d+)(?:[/?#]|$)", 1), F.lit(""))
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    inside = _any([(host == d) | F.endswith(host, F.lit("." + d)) for d in allowed])
    return F.filter(F.array(
        F.when(host == "", "invalid"), F.when(~inside, "domain"), F.when(path.rlike(rf"\.({'|'.join(extensions)})$"), "extension"),
        F.when(port.isNotNull() & ~port.isin([str(p) for p in ports]), "port"), F.when(Rx("[?&](password|token|api_?key|secret)=", "i").test(url), "sensitive"),
    ), lambda x: x.isNotNull())


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def sql_issues(sql: Column, tables: list[str]) -> Column:
    """What a policy for generated SQL holds against a statement."""
    named = F.transform(Rx(r"\b(?:from|join|into|update)\s+([A-Za-z_][\w.]*)", "i").all(sql, 1), F.lower)
    return F.filter(F.array(
        F.when(Rx(r"\b(drop|truncate|alter|grant|revoke)\b", "i").test(sql), "dangerous operation"),
        F.when(Rx(r"\b(delete|update)\b", "i").test(sql) & ~Rx(r"\bwhere\b", "i").test(sql), "missing where"),
        F.when(Rx(r"\bselect\b", "i").test(sql) & ~Rx(r"\blimit\b", "i").test(sql), "missing limit"),
        F.when(F.size(F.array_except(named, F.array(*map(F.lit, tables)))) > 0, "table not allowed"),
        F.when(Rx(r"(--)|(\/\*)|(;\s*\w)|(\b(or|and)\b\s+\d+\s*=\s*\d+)", "i").test(sql), "injection"),
    ), lambda x: x.isNotNull())


def retained(text: Column, strategy: str = "mask") -> Column:
    """Personal data of a text kept for later: masked by kind, removed, or each match replaced by its own digest."""
    from bulwark.operators.input_checks import PII

    for kind, rx in PII.items():
        if strategy == "hash":
            # pieces between matches, and after each but the last the digest of the match
            def digested(found: Column, t: Column = text, pattern: str = rx.java) -> Column:
                marks = F.transform(found, lambda m: F.concat(F.lit("<"), F.substring(F.sha2(m, 256), 1, 16), F.lit(">")))
                return F.array_join(F.zip_with(F.split(t, pattern, -1), marks, lambda a, m: F.concat(F.coalesce(a, F.lit("")), F.coalesce(m, F.lit("")))), "")

            text = let(rx.all(text), digested)
        else:
            text = rx.replace(text, {"mask": f"[{kind.upper()}]", "remove": ""}[strategy])
    return text


def escalation_rate(text: Column, patterns: list[Rx]) -> Column:
    """Matches for each hundred characters."""
    return sum((rx.count(text) for rx in patterns), F.lit(0)) / F.greatest(F.length(text), F.lit(1)) * 100


def review_queue(items: DataFrame) -> DataFrame:
    """Waiting and finished reviews by category (``category, status, micros``)."""
    return items.groupBy("category").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "done").alias("done"), F.min("micros").alias("oldest"))
