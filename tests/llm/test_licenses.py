from __future__ import annotations

import re

from bulwark.llm import licenses

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEXTS = [
    "", "no words here", "Licensed under CC BY-NC 4.0.", "under the MIT License and Apache License, Version 2.0", "SPDX-License-Identifier: GPL-3.0-or-later",
    "the GNU General Public  License version 2 or GNU General-Public/License", "cc by cc by", "amit license", "mit licenses", "émit license", "MIT\nLICENSE", "x " * 5000 + "mit license",
    "see https://opensource.org/licenses/MIT", "permission is hereby granted, free of charge, to any person obtaining a copy of this",
]


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def test_base():
    for text in TEXTS:
        got = licenses.scan(text)
        assert got[:5] == brute(text), text
        assert set(filter(None, got[4].split(","))) <= set(filter(None, got[5].split(",")))
        assert 0 <= got[6] <= 1


def test_rules():
    assert len(licenses.rules()) > 300
    labels = lambda t: licenses.scan(t)[5]
    assert labels(TEXTS[2]) == "cc-by,cc-by-nc"
    assert labels(TEXTS[3]) == "apache,apache-2.0,mit"
    assert labels(TEXTS[4]) == "gpl-3.0"
    assert labels("GNU Lesser General Public License version 2.1") == "lgpl-2.1"  # the shorter title inside is dropped
    assert labels(TEXTS[12]) == "mit" and labels(TEXTS[13]) == "mit"
    assert labels("an ordinary sentence about commits and permits") == ""


def test_every_rule_is_gated_by_a_keyword_it_contains():
    for rule in licenses.rules():
        assert rule.keyword and rule.keyword == rule.keyword.lower()


def test_wrapped_headers():
    labels = lambda t: licenses.scan(t)[5]
    wrap = "\n *" + " " * 15
    assert labels(f"GNU{wrap}Lesser General Public License version 2.1") == "lgpl-2.1"
    holder = "the University of Somewhere Inc. nor the names of its contributors " + "and friends " * 30
    assert "bsd-3-clause" in labels(f"Neither the name of {holder}may be used to endorse{wrap}or promote products")
    assert labels("mit \u8bb8\u53ef license") == "" and labels("mit \u2013 license") == "mit"


def test_long_texts_take_linear_time():
    import time

    began = time.time()
    for part in ("neither the name of ", "license: ", "mit " + "-" * 50, "gnu general public ", "to the extent possible under law, "):
        licenses.scan(part * 20_000)
    assert time.time() - began < 30


def test_documents(docs, edge_rows):
    got = licenses.scan_documents(docs(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    assert {r.n_words for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert licenses.scan_documents(docs([])).count() == 0


def sample(pattern, rng):
    """A random text that the parsed pattern allows, lookarounds aside."""
    out = ""
    for op, av in pattern:
        name = str(op)
        if name == "LITERAL":
            out += chr(av)
        elif name == "NOT_LITERAL":
            out += "~" if av != ord("~") else "!"
        elif name == "IN":
            sets = [(str(o), v) for o, v in av]
            if sets[0][0] == "NEGATE":
                out += rng.choice(" -/")
            else:
                kind, v = rng.choice(sets)
                out += chr(v) if kind == "LITERAL" else chr(rng.randint(*v))
        elif name == "BRANCH":
            out += sample(rng.choice(av[1]), rng)
        elif name == "SUBPATTERN":
            out += sample(av[3], rng)
        elif name == "MAX_REPEAT":
            for _ in range(rng.randint(av[0], min(av[1], av[0] + 2))):
                out += sample(av[2], rng)
    return out


def test_gates_drop_no_match():
    import random

    rng = random.Random(4)
    for rule in licenses.rules():
        parsed = re._parser.parse(rule.pattern.pattern)
        hits = [t for t in (sample(parsed, rng) for _ in range(60)) if rule.pattern.search(t)]
        assert hits, rule
        for t in hits:
            assert rule.keyword in t, (rule, t)
            found = {k for _, ks in licenses.scanner().words.iter(t) for k in ks}
            assert licenses.rules().index(rule) in found
    assert licenses.scan("Available under the Creative Commons Attribution-ShareAlike 4.0 International License")[5] == "cc-by-sa"
