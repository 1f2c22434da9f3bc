"""Undoing evasion tricks before patterns run."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bulwark.functions.regex import GAP, SPACE, Rx, literal
from bulwark.functions.result import let
from bulwark.functions.text import count_hits, trim

#: Invisible format characters.
INVISIBLE = r"[\u00AD\u180E\u200B-\u200F\u2028-\u202F\u2060\uFEFF]"
#: Look-alikes beyond the full-width letters, and the letters they stand for.
LOOK_ALIKES = {
    "а": "a", "о": "o", "е": "e", "р": "p", "с": "c", "х": "x", "і": "i", "ӏ": "d", "у": "y", "ј": "j",
    "α": "a", "ο": "o", "ρ": "p",
}
FULL_WIDTH = {chr(0xFEE0 + c): chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B)]}
HOMOGLYPHS = FULL_WIDTH | LOOK_ALIKES
#: Letter sequences of leetspeak, in the order they are decoded.
LEET_SEQUENCES = [
    (r"\|\\\|", "n"), (r"\|_\|", "u"), (r"\|v\|", "m"), (r"\|<|\|\{", "k"), (r"\|2", "r"), (r"\|\)", "d"),
    (r"\|=", "f"), (r"\|\*", "p"), (r"\/\/\\\\", "m"), (r"\\\/\\\/", "w"), (r"\\\/", "v"), (r"><", "x"),
]
#: Single characters of leetspeak and their letters.
LEET_FROM, LEET_TO = "013456789@$!", "oieasgtbgasi"
#: Misspellings and what they mean.
TYPOS = {
    "ingnore": "ignore", "ignor": "ignore", "ign0re": "ignore", "previ0us": "previous", "previus": "previous", "instrucions": "instructions",
    "instrucion": "instruction", "overide": "override", "overrride": "override", "disreguard": "disregard", "disrega": "disregard",
}
#: Phonetic spellings and what they mean.
PHONETICS = [
    (r"\bignorre?\b", "ignore"), (r"\bign?r\b", "ignore"), (r"\bpr[3e]vious\b", "previous"), (r"\binstr(?:uk|uc)tions?\b", "instructions"),
    (r"\boverryde\b", "override"), (r"\bd[i1]sregard\b", "disregard"), (r"\bpromt\b", "prompt"), (r"\brulz\b", "rules"),
]

#: What words hold that one of those patterns matches.
PHONETIC_SIGNS = ["ignor", "ignr", "igr", "vious", "instr", "overryde", "sregard", "promt", "rulz"]


@dataclass(frozen=True)
class Normalization:
    """Which tricks are undone."""

    enabled: bool = True
    unicode: bool = True
    fold_homoglyphs: bool = True
    strip_invisible: bool = True
    collapse_whitespace: bool = True
    join_letters: bool = True
    lower: bool = True
    leetspeak: bool = True
    typos: bool = True
    phonetics: bool = True


def resolve(options: bool | dict | Normalization | None) -> Normalization:
    """A full configuration from a switch, some flags or a configuration."""
    if isinstance(options, Normalization):
        return options
    if options is False:
        return Normalization(enabled=False)
    return replace(Normalization(), **options) if isinstance(options, dict) else Normalization()


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition; ASCII texts pass through."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def fold_homoglyphs(text: Column) -> Column:
    return let(text, lambda t: F.when(t.rlike(rf"[[^\x00-\x7f]&&[{''.join(LOOK_ALIKES)}\uff21-\uff3a\uff41-\uff5a]]"), F.translate(t, "".join(HOMOGLYPHS), "".join(HOMOGLYPHS.values()))).otherwise(t))


def collapse(text: Column) -> Column:
    # a single blank stays as it is
    return F.regexp_replace(text, f"[[^ -~]&&[{SPACE}]]{GAP}*| {GAP}+", " ")


def join_letters(text: Column) -> Column:
    """Single letters set apart by white space become one word."""
    letter = r"\w"
    two = rf"{letter}{GAP}+{letter}(?!{letter})"
    joined_of = lambda t: F.regexp_replace(t, rf"(?<=(?<!{letter}){letter}){GAP}+(?={letter}(?!{letter}))", "")
    # most texts hold no two such letters, which is told without look-behind
    return let(text, lambda t: F.when(t.rlike(rf"\W{two}") | t.rlike(rf"\A{two}"), joined_of(t)).otherwise(t))


def decode_leet(text: Column) -> Column:
    def sequences(t: Column) -> Column:
        for pattern, letter in LEET_SEQUENCES:
            t = F.regexp_replace(t, Rx(pattern).java, letter)
        return t

    text = replaced(text, ["|", "\\", "><"], sequences)
    # none of the letters is itself replaced
    for character, letter in zip(LEET_FROM, LEET_TO, strict=True):
        text = F.replace(text, F.lit(character), F.lit(letter))
    return text


def replaced(text: Column, signs: list[str], change: Callable[[Column], Column], fold: bool = False) -> Column:
    """The text changed, if it holds one of the signs (``fold``: in any case) without which nothing would change."""
    return let(text, lambda t: F.when(count_hits(F.lower(t) if fold else t, signs) > 0, change(t)).otherwise(t))


def repair_typos(text: Column, fold: bool = True) -> Column:
    def change(t: Column) -> Column:
        for wrong, right in TYPOS.items():
            t = Rx(rf"\b{literal(wrong)}\b", "i").replace(t, right)
        return t

    return replaced(text, list(TYPOS), change, fold)


def repair_phonetics(text: Column, fold: bool = True) -> Column:
    def change(t: Column) -> Column:
        for pattern, right in PHONETICS:
            t = Rx(pattern, "i").replace(t, right)
        return t

    return replaced(text, PHONETIC_SIGNS, change, fold)


def normalize(text: Column, options: bool | dict | Normalization | None = None) -> Column:
    """The text as detectors read it; trimmed only, when disabled.

    Unicode composition is the one step without a built-in, done over Arrow; switch it off for ASCII data.
    """
    c = resolve(options)
    if not c.enabled:
        return trim(text)
    for wanted, step in (
        (c.unicode, nfkc), (c.fold_homoglyphs, fold_homoglyphs), (c.strip_invisible, lambda t: F.regexp_replace(t, rf"[[^\x00-\x7f]&&{INVISIBLE}]", "")),
        (c.collapse_whitespace, collapse), (c.join_letters, join_letters), (c.lower, F.lower), (c.leetspeak, decode_leet),
        (c.typos, lambda t: repair_typos(t, not c.lower)), (c.phonetics, lambda t: repair_phonetics(t, not c.lower)), (c.collapse_whitespace, collapse),
    ):
        if wanted:
            text = step(text)
    return trim(text)
