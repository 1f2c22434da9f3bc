"""Facts that answers state, and answers that contradict each other.

A fact is a numbered item, a statement (with a verb of being or having), or what follows a year, a share, an amount or a span of
time, each up to the end of its sentence.  Texts are cut into sentences first, so that patterns look at one sentence each.

Two facts contradict each other if they are the same but for their numbers, for a year, or for a ``not``.  So facts are grouped by
what is the same, their *frame*, and a frame with several values is a conflict.  No pairs are made: a frame that millions of
answers share has one row for each value, with how many answers give it, and every answer can be joined to its conflicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.functions.regex import SPACE, Rx
from bulwark.functions.text import trim

SENTENCE = "[^.!?]*[.!?]"
VERB = Rx(r"[A-Z][^.!?]*\b(?:is|are|was|were|has|have|had)\b[^.!?]+[.!?]")
#: What every statement holds: a verb between characters of no word.
VERB_LIKE = r"\W(?:is|are|was|were|has|have|had)\W"
DATA = Rx(r"\b(?:\d{4}|\d+%|\$\d+|\d+\s+(?:years?|months?|days?|hours?))\b[^.!?]*[.!?]")
YEAR = Rx(r"\b(?:19|20)\d{2}\b")


def key_facts(text: Column) -> Column:
    """Distinct facts of a text: numbered items, then statements, then data; an unfinished last sentence is none."""
    sentences = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))

    # a run of digits is tried from its first one only
    items = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?<![0-9])[0-9]+\.[{SPACE}]+([^.!?]+[.!?])"), F.lit(1))

    def of(s: Column) -> Column:
        numbered = F.transform(items, trim)
        # one statement a sentence at most, from its first capital: what stands before cannot begin one
        # most sentences are settled by a test without look-around, which the patterns make at every character
        stated = F.transform(F.filter(s, lambda x: x.rlike(VERB_LIKE)), lambda x: F.regexp_extract(F.regexp_replace(x, r"\A[^A-Z]+", ""), rf"\A{VERB.java}", 0))
        data = F.transform(F.filter(s, lambda x: x.rlike("[0-9]")), lambda x: DATA.first(x))
        return F.array_distinct(F.filter(F.concat(numbered, F.transform(stated, trim), F.transform(data, trim)), lambda f: f.isNotNull() & (f != "")))

    return F.transform(F.array(sentences), of)[0]


def frames(fact: Column) -> Column:
    """``kind, frame, value`` of a fact: what it would share with one that contradicts it, and what would differ."""
    empty = F.array().cast("array<struct<kind:string,frame:string,value:string>>")
    one = lambda kind, frame, value: F.array(F.struct(F.lit(kind).alias("kind"), frame.alias("frame"), value.alias("value")))
    number = F.when(fact.rlike("[0-9]"), one("number", F.regexp_replace(fact, "[0-9]+", "X"), F.regexp_extract(fact, "[0-9]+", 0))).otherwise(empty)
    year = F.when(YEAR.test(fact), one("date", YEAR.replace(fact, "YEAR"), YEAR.first(fact))).otherwise(empty)
    # the gap that a "not" leaves is closed, as the two would never meet otherwise
    opposite = one("opposite", F.lower(trim(F.regexp_replace(Rx(r"\bnot\b").replace(fact, ""), f"[{SPACE}]+", " "))), F.contains(fact, F.lit("not")).cast("string"))
    return F.concat(number, year, opposite)


def stated(answers: DataFrame, *within: str) -> DataFrame:
    """``id``, ``within``, ``fact, kind, frame, value`` of all facts of ``id, answer``."""
    facts = answers.select("id", *within, F.explode(key_facts(F.col("answer"))).alias("fact"))
    return facts.select("id", *within, "fact", F.inline(frames(F.col("fact"))))


def conflicts(facts: DataFrame, *within: str) -> DataFrame:
    """``within``, ``kind, frame, value, answers, first_id, values`` of frames with several values, over ``stated`` facts.

    Only answers that agree on ``within`` (such as a topic or a cluster of like prompts) are held against each other.  Answers
    without an id count, and facts that repeat in one answer count once.
    """
    each = facts.select("id", *within, "kind", "frame", "value").distinct()
    values = each.groupBy(*within, "kind", "frame", "value").agg(F.count("*").alias("answers"), F.min("id").alias("first_id"))
    several = values.groupBy(*within, "kind", "frame").agg(F.count("*").alias("values")).filter("values > 1")
    same = F.lit(True)
    for c in (*within, "kind", "frame"):
        same = same & F.col(f"v.{c}").eqNullSafe(F.col(f"s.{c}"))
    return values.alias("v").join(several.alias("s"), same).select("v.*", "s.values")
