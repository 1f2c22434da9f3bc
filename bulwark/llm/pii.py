"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base spans come from one pattern and one test per kind, and their values seed the bootstrap.  Instances are all runs of digits, with
the separators that numbers are written with, and all tokens that hold an ``@``.  Lexical patterns are the words around an
instance (one to the left, two to the left, two to the right, one on either side), each with the coarse class of the instance: an
address, a dotted quad, or a number by how many digits it has, whatever its layout.  Patterns and instances form a graph
that is scored in rounds: a pattern is as good as a lower bound of its distinct instances' mean score, an instance as good as its trusted patterns
together, so that what one round has found supports the patterns of the next.  Patterns that stay confident and rest on enough different
seeds mark the identifiers that the base patterns missed: other layouts, numbers that fail a test, odd addresses.

Each text is read once; what follows works on the few instances found.  Positions are code points, from prefix sums over
the pieces between matches.  The patterns are written with possessive quantifiers and anchored at the start of a run (or at the end
of the previous match), which finds the same matches in time linear in the text.

Defined cases: null counts as an empty text; rows with the same doc_id and text get the same spans; other columns are not
read; a found span never overlaps a base one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import checkpointed, let

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base kinds, in the linear-time form described above.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]++"
#: An instance: a token with an @, or a number with its separators.
INSTANCE = rf"(?<![^{SPACE}])[^{SPACE}@]*+@[^{SPACE}]*+|(?<![0-9A-Za-z])[+(]{{0,2}}[0-9](?:[\x20()./-]{{0,3}}[0-9])*+(?![0-9A-Za-z])"
#: Numbers with fewer digits are no instances.
MIN_DIGITS = 4
#: A pattern must rest on so many different seed values, and keep so much confidence.
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.7
ROUNDS = 3
#: Patterns longer than this go by their digest.
LONG = 80
CHUNK = 64


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the base pattern passes the test of its kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    n = F.length(digits(value))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), F.call_function("luhn_check", digits(value))).otherwise(False)


def running_sums(values: Column) -> Column:
    """Inclusive prefix sums of an array of longs, chunk by chunk so that long arrays take no quadratic time."""
    zero = F.lit(0).cast("long")

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda a, v: a + v)

    def with_values(x: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / CHUNK).cast("int") - 1, F.lit(0)))

        def with_sums(sums: Column) -> Column:
            def one(c: Column) -> Column:
                start = F.struct(total(F.slice(sums, F.lit(1), c)).alias("at"), F.array().cast("array<bigint>").alias("out"))
                return F.aggregate(
                    F.slice(x, c * CHUNK + 1, F.lit(CHUNK)), start,
                    lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"] + v)).alias("out")), lambda a: a["out"],
                )

            return F.flatten(F.transform(chunks, one))

        return let(F.transform(chunks, lambda c: total(F.slice(x, c * CHUNK + 1, F.lit(CHUNK)))), with_sums)

    return let(values, with_values)


def matches(text: Column, pattern: str) -> Column:
    """``value, s, e, piece, rest`` of every match, left to right; ``piece`` is the text since the previous match, ``rest`` that up to the next."""

    def found(v: Column) -> Column:
        def with_pieces(p: Column) -> Column:
            after = F.slice(p, F.lit(2), F.size(v))
            ends = running_sums(F.slice(F.zip_with(p, v, lambda a, m: (F.length(a) + F.length(m)).cast("long")), F.lit(1), F.size(v)))
            placed = F.zip_with(v, ends, lambda m, e: F.struct(m.alias("value"), (e - F.length(m)).alias("s"), e.alias("e")))
            around = F.zip_with(F.slice(p, F.lit(1), F.size(v)), after, lambda a, b: F.struct(a.alias("piece"), b.alias("rest")))
            return F.zip_with(placed, around, lambda m, w: F.struct(m["value"], m["s"], m["e"], w["piece"], w["rest"]))

        return let(F.split(text, pattern, -1), with_pieces)

    empty = F.array().cast("array<struct<value:string,s:bigint,e:bigint,piece:string,rest:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda v: F.when(F.size(v) == 0, empty).otherwise(found(v)))


def scanned(docs: DataFrame) -> DataFrame:
    """One pass over the texts: ``doc_id, th``, the base spans of each kind, and ``tokens`` with their context."""
    text = F.col("text")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def spans(kind: str) -> Column:
        passed = F.filter(matches(text, PATTERNS[kind]), lambda m: valid(kind, m["value"]))
        return F.transform(passed, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"))).alias(kind)

    def instance(m: Column) -> Column:
        lead = F.length(m["value"]) - F.length(F.regexp_replace(m["value"], r"^[\"'(\[{<]++", ""))
        tail = F.length(m["value"]) - F.length(F.regexp_replace(m["value"], r"(?<![\"')\]}>,.;:!?])[\"')\]}>,.;:!?]++$", ""))
        address = F.contains(m["value"], F.lit("@"))
        cut_l, cut_r = F.when(address, lead).otherwise(0), F.when(address, tail).otherwise(0)
        left = F.lower(F.regexp_extract(m["piece"], rf"(?<![^{SPACE}])({WORD})[{SPACE}]*+$", 1))
        left2 = F.lower(F.regexp_extract(m["piece"], rf"(?<![^{SPACE}])({WORD})[{SPACE}]++{WORD}[{SPACE}]*+$", 1))
        right = F.lower(F.regexp_extract(m["rest"], rf"^[{SPACE}]*+({WORD})", 1))
        right2 = F.lower(F.regexp_extract(m["rest"], rf"^[{SPACE}]*+{WORD}[{SPACE}]++({WORD})", 1))
        return F.struct(left.alias("left"), left2.alias("left2"), right.alias("right"), right2.alias("right2"), F.substring(m["value"], cut_l + 1, F.length(m["value"]) - cut_l - cut_r).alias("value"), (m["s"] + cut_l).alias("s"), (m["e"] - cut_r).alias("e"))

    found = F.filter(matches(text, INSTANCE), lambda m: F.contains(m["value"], F.lit("@")) | (F.length(digits(m["value"])) >= MIN_DIGITS))
    instances = F.filter(F.transform(found, instance), lambda t: t["e"] > t["s"])
    return texts.select("doc_id", F.xxhash64("text").alias("th"), *map(spans, KINDS), instances.alias("tokens"))


def kind_of(value: Column) -> Column:
    """The base kind that an instance is on its own, else null."""
    whole = {
        "email": r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$", "ip": r"^[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++$",
        "card": r"^[0-9](?:[\x20-]?[0-9])++$", "phone": r"^\+[0-9][\x20().0-9-]++$",
    }
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(value.rlike(whole[kind]) & valid(kind, value), F.lit(kind)).otherwise(out)
    return out


def class_of(value: Column) -> Column:
    """The coarse class of an instance: an address, a dotted quad, or a number by how many digits the kinds may have."""
    n = F.length(digits(value))
    return (
        F.when(F.contains(value, F.lit("@")), "@").when(value.rlike(r"^[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++$"), "quad")
        .when(n < 9, "few").when(n <= 12, "9-12").when(n <= 15, "13-15").when(n <= 19, "16-19").otherwise("many")
    )


def patterns_of(t: Column) -> Column:
    """The lexical patterns of an instance with context ``left, left2, right, right2``; those without a word are left out."""
    kind = class_of(t["value"])
    each = [
        F.when((F.length(t[names[0]]) > 0) & (F.length(t[names[-1]]) > 0), F.concat_ws("\t", F.lit(mark), kind, *[t[n] for n in names]))
        for mark, names in (("l", ["left"]), ("ll", ["left2", "left"]), ("lr", ["left", "right"]), ("rr", ["right", "right2"]))
    ]
    return F.transform(F.array_compact(F.array(*each)), lambda p: F.when(F.length(p) > LONG, F.sha2(p, 256)).otherwise(p))


def wilson(good: Column, n: Column, z: float = 1.64) -> Column:
    """Lower bound of a share: what few instances claim is not believed."""
    p = good / n
    return (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def trusted_patterns(graph: DataFrame, min_support: int, min_confidence: float) -> DataFrame:
    """``pattern, k, c``: kind and confidence of the patterns that enough good instances support; written, so that Spark can split joins with it."""
    kinds = F.array(*[F.struct(F.count_if(F.col("k") == i).alias("n"), F.lit(-i).alias("o")) for i in range(len(KINDS))])
    scored = graph.groupBy("pattern").agg(
        F.round(wilson(F.sum("s"), F.count("*")), 9).alias("c"), F.count_if(F.col("s") >= min_confidence).alias("support"), (-F.array_max(kinds)["o"]).alias("k"),
    )
    return checkpointed(scored.filter((F.col("c") >= min_confidence) & (F.col("support") >= min_support)).select("pattern", "k", "c"))


def judged(instances: DataFrame, trusted: DataFrame, key: list[str]) -> DataFrame:
    """``key, s_new, k_new`` of the instances with a trusted pattern: 1 - prod(1 - c) over those, and the kind of the best (the first listed of equals)."""
    out = instances.join(trusted, "pattern").groupBy(*key)
    out = out.agg(F.round(1 - F.exp(F.sum(F.log1p(-F.least("c", F.lit(0.999))))), 9).alias("s_new"), F.max(F.struct("c", (-F.col("k")).alias("o"))).alias("best"))
    return out.select(*key, "s_new", (-F.col("best.o")).alias("k_new"))


def confident_patterns(edges: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``trusted_patterns`` of the last round; ``edges`` are ``pattern, v, k`` (kind or null), distinct.

    An instance that is no seed scores nothing until a trusted pattern marks it, else any pattern with some seeds would
    talk itself up.  What a round has marked counts as support in the next one.  Patterns of fewer instances than the support are left out.
    """
    often = checkpointed(edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= min_support).select("pattern"))
    seeds = edges.join(often, "pattern", "left_semi").select("pattern", "v", F.col("k").isNotNull().alias("seed"), "k", F.when(F.col("k").isNotNull(), 1.0).otherwise(0.0).alias("s"))
    graph = checkpointed(seeds)
    trusted = trusted_patterns(graph, min_support, min_confidence)
    for _ in range(rounds - 1):
        marked = checkpointed(judged(graph.filter("not seed").select("pattern", "v"), trusted, ["v"]))
        if marked.isEmpty():
            break
        better = graph.join(marked, "v", "left")
        graph = checkpointed(better.select("pattern", "v", "seed", F.when(F.col("seed"), F.col("k")).otherwise(F.col("k_new")).alias("k"), F.when(F.col("seed"), 1.0).otherwise(F.coalesce("s_new", F.lit(0.0))).alias("s")))
        trusted = trusted_patterns(graph, min_support, min_confidence)
    return trusted


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found, n_spans``; ``n_found`` counts spans beyond the base, ``n_spans`` all."""
    rows = checkpointed(scanned(docs))
    tokens = rows.select("doc_id", "th", F.explode("tokens").alias("t")).select("doc_id", "th", F.explode(patterns_of(F.col("t"))).alias("pattern"), F.col("t.value").alias("value"), "t.s", "t.e")
    number = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    edges = tokens.groupBy("pattern", F.xxhash64("value").alias("v")).agg(F.first("value").alias("value")).select("pattern", "v", number[kind_of(F.col("value"))].alias("k"))
    trusted = confident_patterns(edges)
    found = judged(tokens.filter(kind_of(F.col("value")).isNull()), trusted, ["doc_id", "th", "s", "e"])
    more = found.groupBy("doc_id", "th").agg(F.collect_list(F.struct(F.col("k_new").alias("k"), "s", "e")).alias("more"))
    more = more.select(F.col("doc_id").alias("m_doc_id"), F.col("th").alias("m_th"), "more")

    def numbered(i: int) -> Column:
        return F.transform(KINDS[i], lambda x: F.struct(F.lit(i).alias("k"), x["s"].alias("s"), x["e"].alias("e")))

    base_type = "array<struct<k:int,s:bigint,e:bigint>>"
    base = F.concat(*map(numbered, range(len(KINDS))))
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    out = rows.drop("tokens").withColumn("base", base).join(more, F.col("doc_id").eqNullSafe(F.col("m_doc_id")) & (F.col("th") == F.col("m_th")), "left")
    apart = F.filter("more", lambda m: ~F.exists("base", lambda x: (x["s"] < m["e"]) & (m["s"] < x["e"])))
    out = out.withColumn("more", F.coalesce(apart, F.array().cast(base_type)))
    every = F.when(F.size("more") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return out.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(every).alias("spans"), F.size("more").cast("long").alias("n_found"), (F.size("base") + F.size("more")).cast("long").alias("n_spans"),
    )
