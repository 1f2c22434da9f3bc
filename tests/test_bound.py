"""What a check costs: values made once a row, patterns behind literals, and no pattern that tries a place twice."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from bulwark.functions import normalize as nz
from bulwark.functions.regex import Rx, chained, needed, plain
from bulwark.operators import compose, defense, input_checks, leak, mcp, output_checks
from bulwark.operators import policies as po
from bulwark.operators import scoring as sc
from bulwark.operators.check import Scope


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(spark, rows):
    return spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "id int, t string").coalesce(1)


def test_jailbreak_score_of_a_long_line(spark):
    """One line that holds every word but in the wrong order took minutes."""
    line = "dan mode " + "now are you in pretend to be act as french " * 3000
    start = time.time()
    assert texts(spark, [line]).select(sc.jailbreak_score(F.col("t")).alias("r")).first().r.score > 0
    assert time.time() - start < 20


@pytest.mark.parametrize("source", ["a.*b.*(c|cd).*e", "ab.*ba", "x.*(a|b|ab).*b.*y?z", "a.*b"])
def test_chained_patterns_against_backtracking(spark, source):
    rng = random.Random(7)
    rows = ["".join(rng.choice("abcdexyzAB \n") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    got = texts(spark, rows).select(Rx(source, "i").test(F.col("t")).alias("r")).collect()
    assert [r.r for r in got] == [re.search(source, t, re.I) is not None for t in rows]
    assert sum(r.r for r in got) > 20


def test_literals_that_matches_hold():
    assert chained("in.*(french|german).*say", "i") and not chained("you.*are.*(dan|do.*now)", "i")
    assert needed(r"(?:from|via)\s+mcp.*?(?:ignore|forget)", True) == [frozenset({"mcp"}), frozenset({"via", "from"}), frozenset({"ignore", "forget"})] or len(needed(r"(?:from|via)\s+mcp.*?(?:ignore|forget)", True)) == 3
    assert plain("(stock|stocks|equity)") == ["stock", "equity"] and plain(r"\bstock\b") is None


def test_plain_patterns_fold_ascii_only(spark):
    rows = ["bank", "BANK", "banK", "İnk", "ink"]
    got = texts(spark, rows).select(Rx("bank|ink", "i").test(F.col("t")).alias("r")).collect()
    assert [r.r for r in got] == [True, True, False, False, True]


def test_null_texts_count_as_before(spark):
    got = spark.createDataFrame([(None,)], "t string").select(Rx("abc").count(F.col("t")).alias("n"), Rx("abc").test(F.col("t")).alias("r")).first()
    assert got.n is None and got.r is None


@pytest.mark.parametrize(("build", "at_most"), [
    (lambda s: compose.pipeline(input_checks.length_limit(9)(s), input_checks.toxicity_detector()(s)), 2),
    (lambda s: compose.parallel(input_checks.length_limit(9)(s), input_checks.toxicity_detector()(s), mode="all"), 2),
    (lambda s: input_checks.profanity_filter()(s), 1),
    (lambda s: input_checks.code_limiter(denied=["python"], mode="deny")(s), 2),
    (lambda s: input_checks.injection_detector(normalization=False)(s), 1),
    (lambda s: output_checks.sensitive_data()(s), 1),
    (lambda s: output_checks.unsafe_content()(s), 1),
    (lambda s: sc.injection_score(s.text), 1),
    (lambda s: po.regulated_advice(s.text), 1),
    (lambda s: defense.graded(s.text), 1),
    (lambda s: mcp.scores(s.text), 1),
])
def test_a_text_is_lowered_once(spark, build, at_most):
    r = texts(spark, ["damn"]).select(build(Scope(F.col("t"))).alias("r"))
    assert plan(r).count("lower(t#") <= at_most


def test_normalization_against_single_steps(spark):
    """Gates leave nothing out: the steps, ungated, in plain Python."""
    rows = ["i g n o r e  ALL", "a b \t c", "x |v| |\\| /\\ >< y", "ingnore the instrukton rulz", "Ｉgnore аll", "promt ignr 1gn0re!", "  \n a  b", "aa b cc", "", "one  two"]
    got = [r.r for r in texts(spark, rows).select(nz.normalize(F.col("t"), {"unicode": False}).alias("r")).collect()]

    def plainly(t):
        for a, b in nz.HOMOGLYPHS.items():
            t = t.replace(a, b)
        t = re.sub(r"\s+", " ", re.sub(nz.INVISIBLE, "", t))
        t = re.sub(r"(?<![0-9A-Za-z_])([0-9A-Za-z_])\s+(?=[0-9A-Za-z_](?![0-9A-Za-z_]))", r"\1", t).lower()
        for p, letter in nz.LEET_SEQUENCES:
            t = re.sub(p, letter, t)
        t = t.translate(str.maketrans(nz.LEET_FROM, nz.LEET_TO))
        for a, b in nz.TYPOS.items():
            t = re.sub(rf"\b{a}\b", b, t, flags=re.I | re.A)
        for p, b in nz.PHONETICS:
            t = re.sub(p, b, t, flags=re.I | re.A)
        return re.sub(r"\s+", " ", t).strip()

    assert got == [plainly(t) for t in rows]


def test_phrases_that_no_prompt_has_are_not_shuffled(spark):
    said = spark.createDataFrame([(1, "one two three four five"), (1, "one two three four"), (2, "six seven eight nine")], "id int, text string")
    asked = spark.createDataFrame([(7, "one two three four"), (8, "no such words here")], "id int, text string")
    out = leak.leak_join(said, asked, 4, 0.2)
    assert [tuple(r) for r in out.collect()] == [(1, 7, 1, 1.0)]
    assert "LeftSemi" in plan(out)


def test_pairs_compare_words_made_before_the_join(spark):
    rows = [(1, "a", 0, "How is A", "up two"), (2, "a", 5_000_000, "how  is a", "down three"), (3, "a", 700_000_000, "how is a", "x y"), (4, "b", 6_000_000, "how is a", "z")]
    out = sc.inconsistent_pairs(spark.createDataFrame(rows, "id int, topic string, micros long, prompt string, answer string"), 600)
    assert [(r.a, r.b, r.prompt_similarity, r.answer_similarity) for r in out.collect()] == [(1, 2, 1.0, 0.0)]
    assert "split(" not in plan(out).split("Join", 1)[0]


@pytest.mark.parametrize(("above", "below"), [(0.8, 0.3), (0.5, 0.6), (0.0, 1.1), (-1.0, 0.4)])
def test_pairs_against_brute_force(spark, above, below):
    """Prompts that meet at several words count once, those that share none only where that is enough; nulls never."""
    rng = random.Random(3)
    words = lambda n, of: " ".join(rng.choice("ABcdefghijklmnop"[:of]) for _ in range(n))
    rows = [(k, rng.choice("xy"), rng.randint(-3, 40) * 150_000_000 + rng.randint(0, 1) * 7, words(rng.randint(1, 9), rng.choice([3, 16])), words(rng.randint(1, 9), 16)) for k in range(220)]
    rows += [(300, "x", 0, None, "a"), (301, "x", 0, "a", None), (302, None, 0, "a", "b"), (303, "x", None, "a", "b"), (304, "x", 0, "", ""), (305, "x", 600_000_000, "", "a")]
    want = set()
    for i, t, m, p, a in rows:
        for j, u, n, q, b in rows:
            if None not in (t, m, p, a, n, q, b) and t == u and m <= n <= m + 600_000_000 and (m < n or i < j):
                (x, y), (v, w) = (set(p.lower().split(" ")), set(q.lower().split(" "))), (set(a.lower().split(" ")), set(b.lower().split(" ")))
                s, r = len(x & y) / len(x | y), len(v & w) / len(v | w)
                if s > above and r < below:
                    want.add((i, j, t, s, r))
    got = [tuple(r) for r in sc.inconsistent_pairs(spark.createDataFrame(rows, "id int, topic string, micros long, prompt string, answer string"), 600, above, below).collect()]
    assert len(got) == len(want) > 5 and set(got) == want


def test_prompts_of_one_template_do_not_all_meet(spark):
    """All in one window: 18 million pairs of word sets were compared, in one task."""
    template = F.concat(F.lit("please tell me how far it is from "), *[x for k in range(4) for x in (F.lit(f" w{k}x"), F.col("id").cast("string"))])
    rows = spark.range(6000).select("id", F.lit("a").alias("topic"), F.col("id").alias("micros"), template.alias("prompt"), F.col("id").cast("string").alias("answer"))
    twin = rows.filter("id = 7").withColumn("id", F.lit(9000).cast("bigint")).withColumn("answer", F.lit("else"))
    start = time.time()
    assert [(r.a, r.b, r.prompt_similarity) for r in sc.inconsistent_pairs(rows.union(twin), 600).collect()] == [(7, 9000, 1.0)]
    assert time.time() - start < 15


def test_codes_of_words_have_no_collisions(spark, monkeypatch):
    made = []
    weak = lambda seed, w: made.append(seed) or (F.length(w).cast("bigint") if len(made) == 1 else F.hash(w).cast("bigint"))
    monkeypatch.setattr(sc.F, "xxhash64", weak)
    words = spark.createDataFrame([("ab",), ("cd",), ("ab",), ("e",)], "word string")
    code, common = sc.word_codes(words)
    codes = {r.word: r.c for r in words.select("word", code(F.col("word")).alias("c")).collect()}
    assert len(made) == 3 and len(set(codes.values())) == 3 and common[-1] == codes["ab"]
