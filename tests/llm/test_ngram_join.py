from __future__ import annotations

import random
from collections import Counter

import pytest

from bulwark.llm import ngram_join as nj


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = [*range(len(rows))]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j, k in Counter(j for x in s for j in at[x] if j > i).items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
    none = 1 << 62
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), none), none if d is None else d)
    name = lambda i: None if least[find(i)] == none else least[find(i)]
    return sorted(str((d, len(sets[i]), name(i))) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (None, "a b"), (None, "x y z q r s t"), (7, "x y z q r s t"), (7, "other text here with words more"), (7, "x y z q r s t")]
    passage = " ".join(rng.choice(words) for _ in range(30))
    base = [rng.choice(words) for _ in range(80)]

    def edited(text, most):
        text = list(text)
        for _ in range(rng.randint(0, most)):
            text[rng.randrange(len(text))] = rng.choice(words)
        return " ".join(text)

    rows += [(100 + k, edited(base, 5)) for k in range(120)]
    for _ in range(50):
        own = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 6)):
            rows.append((100 + len(rows), (passage + " ") * (rng.random() < 0.3) + edited(own, 4)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("rounds", "block", "fragment"), [(2, 512, 1_500_000), (0, 16, 50), (1, 7, 200)])
def test_components(spark, monkeypatch, rounds, block, fragment):
    monkeypatch.setattr(nj, "BLOCK", block)
    monkeypatch.setattr(nj, "FRAGMENT", fragment)
    rows = corpus(rounds)
    got = nj.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rounds).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(rows)


def test_one_of_each(docs, edge_rows):
    df = docs([*edge_rows, (20, "a b c d e f", "en", "s"), (21, " ".join(f"w{k}" for k in range(60)), "en", "s"), (22, " ".join(f"w{k}" for k in range(58)), "en", "s")])
    out = nj.one_of_each(df)
    assert out.columns == df.columns
    got = sorted((str(r.doc_id), (r.text or "")[:12]) for r in out.collect())
    assert got == sorted([("1", "")] + [("2", ""), ("3", " \t\n"), ("4", "a b c d e f"), ("4", "another text"), ("5", "é" * 10), ("6", "word word wo"), ("7", "x" * 12), ("8", "😀 ok\n\n"), ("21", "w0 w1 w2 w3 ")])


def test_empty(docs):
    assert nj.similar_groups(docs([])).count() == 0
    assert nj.one_of_each(docs([])).count() == 0
