"""Measures and small transforms of text, as Column expressions with ECMAScript semantics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bulwark.functions.regex import GAP, Rx, literal
from bulwark.functions.result import let


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def length16(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int"))


def count_bytes(text: Column) -> Column:
    return F.octet_length(text)


def words(text: Column) -> Column:
    """Pieces between white space, none empty."""
    return F.filter(F.split(text, f"{GAP}+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.size(words(or_empty(text)))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{GAP}+|{GAP}+\z", "")


def scan_text(prompt: Column, messages: Column | None = None, system: Column | None = None) -> Column:
    """Prompt, message contents and system prompt, joined by one space each, empty parts included.

    ``messages`` is an array of structs with ``content``.
    """
    parts = F.array(or_empty(prompt))
    if messages is not None:
        parts = F.concat(parts, F.transform(F.coalesce(messages, F.array().cast("array<struct<role:string,content:string>>")), lambda m: or_empty(m["content"])))
    return F.array_join(F.concat(parts, F.array(or_empty(system) if system is not None else F.lit(""))), " ")


def normalized_context(messages: Column) -> Column:
    """``prompt, messages, system`` of a message array: the first system message, the others' text joined by a space."""
    system = F.filter(messages, lambda m: m["role"] == "system")
    rest = F.filter(messages, lambda m: m["role"] != "system")
    prompt = F.array_join(F.transform(rest, lambda m: or_empty(m["content"])), " ")
    return F.struct(prompt.alias("prompt"), rest.alias("messages"), or_empty(F.get(F.transform(system, lambda m: m["content"]), F.lit(0))).alias("system"))


def output_text(content: Column, output: Column, text: Column) -> Column:
    """Text parts of ``content`` if there are any, else the object as JSON, else ``text``; never null.

    ``content`` is an array of structs with ``type`` and ``text``; ``output`` is JSON text or null.
    """
    parts = F.filter(F.coalesce(content, F.array().cast("array<struct<type:string,text:string>>")), lambda p: (p["type"] == "text") & (p["text"] != ""))
    joined = F.array_join(F.transform(parts, lambda p: p["text"]), "")
    return F.coalesce(F.nullif(joined, F.lit("")), F.nullif(text, F.lit("")), output, F.lit(""))


def stringified(text: Column, output: Column, accumulated: Column | None = None) -> Column:
    """Accumulated text even if empty, else non-empty text, else the object as JSON, else empty."""
    rest = F.coalesce(F.nullif(text, F.lit("")), output, F.lit(""))
    return rest if accumulated is None else F.coalesce(accumulated, rest)


def usage(prompt_tokens: list[Column], completion_tokens: list[Column], total: list[Column]) -> Column:
    """Token usage from the aliases that are filled; null if all are absent."""
    p, c, t = F.coalesce(*prompt_tokens), F.coalesce(*completion_tokens), F.coalesce(*total)
    whole = F.coalesce(t, F.when(p.isNotNull() | c.isNotNull(), F.coalesce(p, F.lit(0)) + F.coalesce(c, F.lit(0))))
    return F.when(whole.isNotNull(), F.struct(p.cast("long").alias("prompt_tokens"), c.cast("long").alias("completion_tokens"), whole.cast("long").alias("total_tokens")))


@F.pandas_udf(T.DoubleType())
def entropy(text: pd.Series) -> pd.Series:
    """Shannon entropy in bits: characters by code point, over the length in UTF-16 units.

    Built-ins can count characters too, but sorting those of a long text took over 6,000 CPU seconds a GB.
    """

    def bits(t: str | None) -> float | None:
        if not t:
            return None if t is None else 0.0
        points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        shares = np.unique(points, return_counts=True)[1] / (len(points) + np.count_nonzero(points > 0xFFFF))
        return float(-(shares * np.log2(shares)).sum())

    return pd.Series([bits(t) for t in text], dtype="float64")


def luhn(text: Column) -> Column:
    """Whether 13 to 19 digits of the text pass the mod-10 check."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(False)


def mask(text: Column, kind: str) -> Column:
    """A match made unreadable, by kind."""
    if kind == "email":
        return F.regexp_replace(text, r"^(.{2})[^@]*(@.*)$", "$1***$2")
    if kind == "phone":
        return F.regexp_replace(text, r"(\d{3})\d{3}(\d{4})", "$1***$2")
    if kind == "ssn":
        return F.regexp_replace(text, r"(\d{3})-\d{2}-(\d{4})", "$1-**-$2")
    if kind == "creditCard":
        return F.regexp_replace(text, r"(\d{4})\d{8,11}(\d{4})", "$1****$2")
    return F.regexp_replace(text, r"^(.{4}).*(.{4})$", "$1***$2")


def word_boundary(word: str) -> Rx:
    """Case-insensitive pattern of a whole word."""
    return Rx(rf"\b{literal(word)}\b", "i")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters plus half of the words, rounded up."""
    return F.when(or_empty(text) == "", 0).otherwise(F.ceil(length16(text) / F.lit(4.0) + count_words(text) / F.lit(2.0))).cast("int")


def fnv1a(text: Column) -> Column:
    """FNV-1a (32 bits) over code points, eight hex digits."""
    state = F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"),
        lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619), F.lit(4294967296)).cast("long"),
    )
    return F.lower(F.lpad(F.hex(state), 8, "0"))


def code_point_label(character: Column) -> Column:
    return F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(character)), 4, "0"))


def overlap(a: Column, b: Column) -> Column:
    """Words of ``a`` that ``b`` has too, over the longer of both; 0 if one has none."""

    def shared(p: Column) -> Column:
        x, y = p["x"], p["y"]
        common = F.size(F.filter(x, lambda w: F.array_contains(y, w)))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(common / F.greatest(F.size(x), F.size(y)))

    return let(F.struct(words(F.lower(a)).alias("x"), words(F.lower(b)).alias("y")), shared)


def has(text_lower: Column, needle: str) -> Column:
    return F.contains(text_lower, F.lit(needle))


def hits(text_lower: Column, needles: list[str]) -> Column:
    """Those of the literals that the text has, in list order."""
    return let(text_lower, lambda t: F.array_compact(F.array(*[F.when(has(t, n), F.lit(n)) for n in needles]))) if needles else F.array().cast("array<string>")


def count_hits(text_lower: Column, needles: list[str]) -> Column:
    """How many of the literals the text has; the text is made once, not for each of them."""
    return let(text_lower, lambda t: sum((has(t, n).cast("int") for n in needles), F.lit(0)))


def which(tests: dict[str, Column]) -> Column:
    """Names of the tests that hold, in order."""
    return F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())


def sql_hits(needles: list[str], text: str = "lower(t)") -> str:
    """DuckDB's count of the literals that a text has."""
    from bulwark.functions.regex import quoted

    return "(" + " + ".join(f"CAST(contains({text}, {quoted(n)}) AS INTEGER)" for n in needles) + ")"
