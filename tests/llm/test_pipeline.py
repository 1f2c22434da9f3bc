from __future__ import annotations

import random
import re

import corpus_pipeline
from bulwark.llm import line_dedup, quality
from bulwark.llm.common import tokenizer_path
from tokenizers import Tokenizer


def prose(rng, n):
    words = "the of and to in that with from this have which their about people water after during between small house garden morning river light stone winter letter window music bridge".split()
    return " ".join(rng.choice(words) for _ in range(n))


def corpus(seed=9):
    rng = random.Random(seed)
    rows = []
    for k in range(120):
        body = prose(rng, rng.randint(60, 200))
        if k % 4 == 0:
            body += "\nSubscribe to our newsletter today"
        rows.append((k, body, "en", f"s{k % 7}"))
    rows += [(200 + k, rows[k][1] + " extra", "en", "s1") for k in range(10)]  # near copies
    rows += [(300, "too short", "en", "s0"), (301, None, None, None), (302, "same words " * 100, "en", "s2")]
    return rows


def brute(rows):
    """The five stages in plain Python, up to the choice that random offsets make: the set of documents that reach the mix."""
    vocabularies = [quality.vocabulary_of(tokenizer_path(v)) for v in quality.VOCABULARIES]
    kept = []
    for i, t, lang, s in rows:
        raw = (t or "").encode()
        for v in vocabularies:
            v.learn(set(raw.split()))
        if quality.measure(raw, raw.split(), lang, vocabularies, quality.BANDS)[6]:
            kept.append((i, t, s))
    sites = {}
    for _, t, s in kept:
        for line in t.split("\n"):
            sites.setdefault(line.strip(), set()).add(s)
    clean = []
    for i, t, s in kept:
        lines = t.split("\n")
        gone = [x for x in lines if x.strip() and len(sites[x.strip()]) >= line_dedup.MIN_SITES]
        if any(x.strip() and x not in gone for x in lines):
            t = "\n".join(x for x in lines if x not in gone)
        clean.append((i, t, s))
    sets = []
    for _, t, _ in clean:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    comp = [*range(len(clean))]
    for a in range(len(clean)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                comp = [comp[b] if c == comp[a] else c for c in comp]
    least = {}
    for k, c in enumerate(comp):
        least[c] = min(least.get(c, 1 << 60), clean[k][0])
    return {clean[k][0]: clean[k][1] for k, c in enumerate(comp) if clean[k][0] == least[c]}


def staged(spark, docs, upto):
    for _, stage in corpus_pipeline.STAGES[:upto]:
        docs = stage(spark, docs, "")
    return docs


def test_stages(spark, docs):
    rows = corpus()
    want = brute(rows)
    deduped = staged(spark, docs(rows), 3)
    assert deduped.columns == docs([]).columns
    got = {r.doc_id: r for r in deduped.collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert 200 not in got and 300 not in got and 302 not in got and "newsletter" not in "".join(want.values())


def test_whole_pipeline(spark, docs, tmp_path):
    rows = corpus(10)
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute(rows)
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    assert {r.doc_id for r in out} <= set(want)
    for r in out:
        assert r.n_tokens == len(lib.encode(want[r.doc_id], add_special_tokens=False).ids)
    assert max(sum(x.doc_id == r.doc_id for x in out) for r in out) <= 3


def test_empty(spark, docs):
    assert staged(spark, docs([]), 5).count() == 0
