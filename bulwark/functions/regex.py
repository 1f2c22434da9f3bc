"""ECMAScript regular expressions as Java (Spark) and RE2 (DuckDB) ones."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from functools import cache, reduce
from itertools import product
from re import _constants as k
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript has it.
SPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same white space as a class that passes over ASCII letters at once.
GAP = rf"[[^!-~]&&[{SPACE}]]"
#: Line ends that its dot leaves out.
LINE_END = r"\n\r\u2028\u2029"
#: ASCII word boundary; Java's own follows Unicode letters, but its ``\w`` is of ASCII, and far quicker than a class of ranges.
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


@dataclass(frozen=True)
class Rx:
    """A pattern in ECMAScript syntax with its flags (``i``, ``s``, ``m``)."""

    source: str
    flags: str = ""

    @property
    def java(self) -> str:
        """The same language for ``rlike`` and its kin."""
        return prefix(self.flags, "is") + translate(self.source, "s" in self.flags, "m" in self.flags)

    @property
    def re2(self) -> str:
        """The same language for DuckDB, for patterns without look-around, over ASCII white space."""
        return prefix(self.flags, "ism") + self.source

    @property
    def required(self) -> str:
        """The longest literal that every match holds, in lower case if case does not count; empty if none is found."""
        best = longest_literal(self.source)
        return best.lower() if "i" in self.flags else best

    def gate(self, text: Column, lower: Column | None = None) -> Column | None:
        """A cheap test that every matching text passes: literal searches are many times faster than a pattern.

        ``lower`` is the text in lower case; null if the pattern holds no literal to look for.
        """
        held = text if "i" not in self.flags else F.lower(text) if lower is None else lower
        each = [held.rlike(DIGITS) if c == {DIGITS} else reduce(Column.__or__, [F.contains(held, F.lit(x)) for x in sorted(c)]) for c in needed(self.source, "i" in self.flags)]
        return reduce(Column.__and__, each) if each else None

    @property
    def searched(self) -> str:
        """A pattern that is found in the same texts: literals with ``.*`` between them are looked for once a line, left to right."""
        return chained(self.source, self.flags) or self.java

    def test(self, text: Column, lower: Column | None = None) -> Column:
        """Whether the text matches, literal searches first; they settle patterns that are a few literals."""
        gate, words = self.gate(text, lower), plain(self.source)
        found = text.rlike(self.searched)
        if words and "i" in self.flags:
            low = F.lower(text) if lower is None else lower
            # these two are the only characters whose lower case is a letter of ASCII that the pattern does not match
            odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
            found = reduce(Column.__or__, [F.contains(low, F.lit(w.lower())) for w in words]) & (~odd | found)
        elif words:
            found = reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])
        return found if gate is None else gate & found

    def count(self, text: Column, lower: Column | None = None) -> Column:
        gate = self.test(text, lower) if plain(self.source) else self.gate(text, lower)
        found = F.regexp_count(text, F.lit(self.java))
        return found if gate is None else F.when(~gate, 0).otherwise(found)

    def all(self, text: Column, group: int = 0) -> Column:
        return F.regexp_extract_all(text, F.lit(self.java), group)

    def first(self, text: Column, group: int = 0) -> Column:
        return F.regexp_extract(text, self.java, group)

    def replace(self, text: Column, by: str) -> Column:
        return F.regexp_replace(text, self.java, by)

    def sql(self, text: str = "t") -> str:
        """DuckDB's test."""
        return f"regexp_matches({text}, {quoted(self.re2)})"

    def sql_count(self, text: str = "t") -> str:
        return f"len(regexp_extract_all({text}, {quoted(self.re2)}))"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def prefix(flags: str, known: str) -> str:
    used = "".join(f for f in known if f in flags)
    return f"(?{used})" if used else ""


def longest_literal(source: str) -> str:
    """The longest run of plain characters outside groups, classes and optional parts; none where alternatives stand on top."""
    best, run, depth, i = "", "", 0, 0
    while i < len(source):
        c = source[i]
        step, plain = 1, None
        if c == "\\":
            step = 2
            plain = source[i + 1] if not source[i + 1].isalnum() else None
        elif c == "[":
            end = i + 1
            while source[end] != "]":
                end += 2 if source[end] == "\\" else 1
            step = end + 1 - i
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and not depth:
            return ""
        elif c == "{" and not depth:
            step = source.index("}", i) + 1 - i
        elif c not in ".^$*+?|{}":
            plain = c
        after = source[i + step : i + step + 1]
        if depth or plain is None or c == ")":
            best, run = max(best, run, key=len), ""
        elif after and after in "?*{":
            best, run = max(best, run, key=len), ""
        elif after == "+":
            best, run = max(best, run + plain, key=len), ""
        else:
            run += plain
        i += step
    return max(best, run, key=len)


#: What a text with a number of three digits or more holds.
DIGITS = "[0-9]{3}"
REPEATS = (k.MAX_REPEAT, k.MIN_REPEAT, k.POSSESSIVE_REPEAT)


def parsed(source: str) -> list | None:
    """The pattern as Python's parser has it; null if that does not take it."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return list(_parser.parse(source))
        except re.error:
            return None


@cache
def needed(source: str, fold: bool) -> list[frozenset[str]]:
    """Sets of literals, of each of which every match holds one, the most telling first; ``fold``: in lower case."""
    every = held(parsed(source) or [])
    telling = [c for c in every if all(len(x) >= 3 or not x.isalnum() and x.strip() for x in c)] or [c for c in every if min(map(len, c)) >= 2]
    lower = [{x if x == DIGITS else x.lower() for x in c} if fold else c for c in telling]
    lower = {frozenset(x for x in c if not any(y != x and y in x for y in c)) for c in lower}
    return sorted(lower, key=lambda c: (len(c), -min(map(len, c)), sorted(c)))


def held(sequence: list) -> list[set[str]]:
    """``needed`` of a parsed sequence, in order, however short the literals."""
    out, run = [], ""

    def ended() -> str:
        if run and run.isascii():
            out.append({run})
        return ""

    for op, arg in sequence:
        if op == k.LITERAL:
            run += chr(arg)
            continue
        if op == k.AT:
            continue
        run = ended()
        if op == k.SUBPATTERN:
            out += held(list(arg[3]))
        elif op == k.BRANCH:
            best = [max(held(list(b)), key=lambda c: min(map(len, c)), default=None) for b in arg[1]]
            if all(best):
                out.append(set().union(*best))
        elif op in REPEATS and arg[0]:
            inner = list(arg[2])
            if inner[0][0] == k.IN and inner[0][1] in ([(k.CATEGORY, k.CATEGORY_DIGIT)], [(k.RANGE, (48, 57))]) and arg[0] >= 3:
                out.append({DIGITS})
            else:
                out += held(inner)
    ended()
    return out


def spelled(sequence: list) -> list[str] | None:
    """All texts that a parsed sequence matches, shorter ones first; null if they are not a few literals."""
    parts = []
    for op, arg in sequence:
        if op == k.LITERAL:
            parts.append([chr(arg)])
        elif op == k.SUBPATTERN:
            parts.append(spelled(list(arg[3])))
        elif op == k.BRANCH:
            each = [spelled(list(b)) for b in arg[1]]
            parts.append(None if None in each else [x for e in each for x in e])
        elif op == k.IN and all(o == k.LITERAL for o, _ in arg):
            parts.append([chr(c) for _, c in arg])
        elif op in REPEATS and arg[:2] == (0, 1):
            inner = spelled(list(arg[2]))
            parts.append(None if inner is None else ["", *inner])
        else:
            return None
        if parts[-1] is None or len(parts[-1]) > 64:
            return None
    every = {"".join(x) for x in product(*parts)} if parts else set()
    return sorted(every, key=lambda x: (len(x), x)) if 0 < len(every) <= 64 and "" not in every else None


@cache
def plain(source: str) -> list[str] | None:
    """Literals of which one stands in a text if and only if the pattern matches; null if it is not as plain."""
    every = spelled(parsed(source) or [])
    return [x for x in every if not any(y != x and y in x for y in every)] if every and all(x.isascii() for x in every) else None


@cache
def chained(source: str, flags: str) -> str | None:
    """A pattern found in the same texts as literals with ``.*`` between, in time linear in a line; null if ``source`` is none.

    Where each literal is found at its first place after the one before, the rest has most room; so nothing is tried twice.
    That holds unless a longer spelling of a part has a shorter one inside, which may end before it.
    """
    tree = parsed(source) or []
    steps, part = [], []
    for op, arg in tree:
        if op == k.MAX_REPEAT and arg[0] == 0 and arg[1] == k.MAXREPEAT and list(arg[2]) == [(k.ANY, None)]:
            steps.append(part)
            part = []
        else:
            part.append((op, arg))
    each = [spelled(p) for p in [*steps, part]]
    if not steps or None in each or any(a in b[1:] for e in each[:-1] for a in e for b in e):
        return None
    gap, start = ("(?s:.)", r"\A") if "s" in flags else (f"[^{LINE_END}]", rf"(?:\A|(?<=[{LINE_END}]))")
    return prefix(flags, "is") + start + "".join(f"(?>{gap}*?(?:{'|'.join(map(literal, e))}))" for e in each)


def boundary(before: str, after: str) -> str:
    """A word boundary; half a test where one side is known to be a word character."""
    if re.match(r"(?:[0-9A-Za-z_]|\\[dw]|\[0-9\])(?![?*])", after) or (m := re.match(r"\((?:\?:)?([^()\[\]\\?*|]\w*(?:\|[^()\[\]\\?*|][^()\[\]\\?*|]*)*)", after)) and all(a[:1].isalnum() and a[:1].isascii() for a in m[1].split("|")) and re.match(r"\)(?![?*{])", after[m.end() :]):
        return r"(?<!\w)"
    if re.search(r"(?:[0-9A-Za-z_]|\\d\{\d+(?:,\d+)?\})$", before) and not re.search(r"\\[a-zA-Z]$", before):
        return r"(?!\w)"
    return BOUNDARY


def translate(source: str, dot_all: bool = False, multiline: bool = False) -> str:
    """Java syntax of an ECMAScript pattern."""
    out, i, inside = [], 0, False
    while i < len(source):
        c = source[i]
        if c == "\\" and i + 1 < len(source):
            pair = source[i : i + 2]
            i += 2
            if pair == r"\s":
                out.append(SPACE if inside else GAP)
            elif pair == r"\S" and not inside:
                out.append(rf"[^{SPACE}]")
            elif pair == r"\b" and not inside:
                out.append(boundary(source[: i - 2], source[i:]))
            elif pair == r"\/":
                out.append("/")
            elif pair == r"\0":
                out.append(r"\x00")
            else:
                out.append(pair)
            continue
        if inside:
            out.append("\\[" if c == "[" else "\\&" if c == "&" else c)
            inside = c != "]"
        elif source.startswith(r"[\s\S]", i):
            out.append(r"(?s:.)")
            i += 6
            continue
        elif c == "[":
            inside = True
            out.append(c)
        elif c == "." and not dot_all:
            out.append(f"[^{LINE_END}]")
        elif c == "$":
            out.append(rf"(?=[{LINE_END}]|\z)" if multiline else r"\z")
        elif c == "^" and multiline:
            out.append(rf"(?:\A|(?<=[{LINE_END}]))")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def literal(text: str) -> str:
    """A pattern that matches ``text`` itself."""
    return "".join(f"\\{c}" if c in r".*+?^${}()|[]\/" else c for c in text)
