from __future__ import annotations

import re

from pyspark.sql import functions as F

from bulwark.operators import facts as fa

TEXTS = [
    "Intro text. 1. Water boils at 100 degrees. 2. Ice melts! The garden has 12 trees. It was planted in 1999 by hand. Growth of 5 years followed. unfinished sentence is",
    "nothing here. lower case is no statement. the Thing is one though. Prices rose $20 then. About 30%x more? No", "", None, "A is. B was x!! C had y? 7. And 8. Then 9. ", "x" * 200_000 + ". The end is near.", "Is A has B. 2001 was. 12 hours",
]


def brute(text):
    text = text or ""
    found = [re.sub(r"^\d+\.\s+", "", f).strip() for f in re.findall(r"\d+\.\s+[^.!?]+[.!?]", text)] if len(text) < 1000 else []
    if len(text) < 1000:
        found += [m[0].strip() for m in re.finditer(r"[A-Z][^.!?]*\b(is|are|was|were|has|have|had)\b[^.!?]+[.!?]", text)]
        found += [m[0].strip() for m in re.finditer(r"\b(\d{4}|\d+%|\$\d+|\d+\s+(years?|months?|days?|hours?))\b[^.!?]*[.!?]", text)]
    else:
        found = ["The end is near."]
    return [*dict.fromkeys(found)]


def test_key_facts(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string").coalesce(1)
    for r in df.select("k", fa.key_facts(F.col("t")).alias("f")).collect():
        assert r.f == brute(TEXTS[r.k]), TEXTS[r.k]


def plain(fact):
    return " ".join(re.sub(r"\bnot\b", "", fact).split()).lower()


def contradict(a, b):
    """Whether two facts do, pair by pair."""
    kinds = set()
    x, y = re.findall(r"\d+", a), re.findall(r"\d+", b)
    if x and y and re.sub(r"\d+", "X", a) == re.sub(r"\d+", "X", b) and x[0] != y[0]:
        kinds.add("number")
    if ("not" in a) != ("not" in b) and plain(a) == plain(b):
        kinds.add("opposite")
    x, y = re.search(r"\b(19|20)\d{2}\b", a), re.search(r"\b(19|20)\d{2}\b", b)
    if x and y and re.sub(r"\b(19|20)\d{2}\b", "YEAR", a) == re.sub(r"\b(19|20)\d{2}\b", "YEAR", b) and x[0] != y[0]:
        kinds.add("date")
    return kinds


def test_conflicts_are_those_of_all_pairs(spark):
    rows = []
    for k in range(60):
        rows.append((k, "ab"[k % 2], f"The garden has {k % 3} trees. It was founded in {1990 + k % 2}. The gate is{' not' if k % 5 == 0 else ''} open. Nothing has changed since 1900. Row {k} is here."))
    rows += [(None, "a", "The garden has 9 trees. "), (100, None, "The garden has 1 trees. The garden has 1 trees."), (101, None, "The garden has 2 trees."), (102, "a", None)]
    df = spark.createDataFrame(rows, "id long, topic string, answer string").repartition(3)
    facts = fa.stated(df, "topic")
    got = {(r.topic, r.kind, r.frame, r.value): (r.answers, r["values"]) for r in fa.conflicts(facts, "topic").collect()}
    want = {}
    said = [(i, t, f) for i, t, a in rows for f in brute(a)]
    for i, t, a in said:
        for _, u, b in said:
            if t == u:
                for kind in contradict(a, b):
                    frame = {"number": re.sub(r"\d+", "X", a), "date": re.sub(r"\b(19|20)\d{2}\b", "YEAR", a), "opposite": plain(a)}[kind]
                    value = {"number": (re.findall(r"\d+", a) or [""])[0], "date": (re.findall(r"\b(?:19|20)\d{2}\b", a) or [""])[0], "opposite": str("not" in a).lower()}[kind]
                    want.setdefault((t, kind, frame, value), set()).add(i)
    assert {k: n for k, (n, _) in got.items()} == {k: len(v) for k, v in want.items()}
    assert {kind for _, kind, _, _ in got} == {"number", "date", "opposite"}
    assert got[("a", "number", "The garden has X trees.", "9")] == (1, 4) and got[(None, "number", "The garden has X trees.", "1")] == (1, 2)
    assert fa.conflicts(fa.stated(df.limit(0), "topic"), "topic").count() == 0
