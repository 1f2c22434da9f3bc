from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bulwark.functions import normalize as nz
from bulwark.functions import text as tx
from bulwark.functions.regex import Rx, literal


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_scan_text_joins_empty_parts(spark):
    t = tx.scan_text(F.col("t"))
    assert one(spark, t, t="abc") == "abc "
    assert one(spark, tx.length16(t), t="This is a very long prompt that exceeds the limit") == 50
    rows = spark.sql("select 'Hi' as p, array(named_struct('role', 'user', 'content', 'Hello there')) as m, cast(null as string) as s")
    assert rows.select(tx.scan_text(F.col("p"), F.col("m"), F.col("s"))).first()[0] == "Hi Hello there "


def test_lengths(spark):
    assert one(spark, tx.length16(F.col("t")), t="a😀b") == 4
    assert one(spark, tx.count_words(F.col("t")), t="  one two three\n") == 3
    assert one(spark, tx.count_words(F.col("t")), t="") == 0
    assert one(spark, tx.count_bytes(F.col("t")), t="é😀") == 6
    assert one(spark, tx.estimate_tokens(F.col("t")), t="abcd efgh") == 4
    assert one(spark, tx.estimate_tokens(F.col("t")), t="") == 0


@pytest.mark.parametrize(
    ("rx", "text", "want"),
    [
        (Rx(r"\bhell\b"), "éhell", True), (Rx(r"\bhell\b"), "shell", False), (Rx(r"a\sb"), "a b", True), (Rx(r"^[^\s]+$"), "a b", False), (Rx("a.b"), "a\nb", False),
        (Rx("a.b", "s"), "a\nb", True), (Rx("x$"), "x\n", False), (Rx("IGNORE", "i"), "ignore", True), (Rx(r"[\s\S]{3}"), "a\nb", True), (Rx(r"\/etc\/"), "/etc/", True), (Rx(literal("a.b[c]")), "a.b[c]", True),
        (Rx(r"[[a]"), "[", True),
    ],
)
def test_regular_expressions(spark, rx, text, want):
    assert one(spark, rx.test(F.col("t")), t=text) is want


@pytest.mark.parametrize(
    ("text", "want", "options"),
    [
        ("1gn0re prev10us 1nstruct10ns", "ignore previous instructions", None), ("ＩＧＮＯＲＥ ＰＲＥＶＩＯＵＳ", "ignore previous", None), ("а о е р с х", "a o e p c x", {"join_letters": False}),
        ("j a i l b r e a k", "jailbreak", None), ("ingnore the overide", "ignore the override", None), ("promt and rulz", "prompt and rules", None), ("  1gn0re  ", "1gn0re", False),
        ("1gn0re ＡＢＣ", "1gn0re abc", {"leetspeak": False}), ("ig​nore­", "ignore", None),
    ],
)
def test_normalization(spark, text, want, options):
    assert one(spark, nz.normalize(F.col("t"), options), t=text) == want


def test_small_functions(spark):
    assert one(spark, tx.luhn(F.col("t")), t="4111-1111-1111-1111") is True
    assert one(spark, tx.luhn(F.col("t")), t="4111-1111-1111-1112") is False
    assert one(spark, tx.luhn(F.col("t")), t="0") is False
    assert one(spark, tx.mask(F.col("t"), "email"), t="john@example.com") == "jo***@example.com"
    assert one(spark, tx.mask(F.col("t"), "ssn"), t="123-45-6789") == "123-**-6789"
    assert one(spark, tx.fnv1a(F.col("t")), t="") == "811c9dc5"
    assert one(spark, tx.fnv1a(F.col("t")), t="a") == "e40c292c"
    assert one(spark, F.round(tx.entropy(F.col("t")), 6), t="aabb") == 1.0
    assert one(spark, tx.entropy(F.col("t")), t="") == 0.0
    assert one(spark, tx.code_point_label(F.col("t")), t="​") == "U+200B"
    assert one(spark, tx.overlap(F.col("a"), F.col("b")), a="a b c", b="B x") == pytest.approx(1 / 3)


@pytest.mark.parametrize(
    ("rx", "texts"),
    [
        (Rx(r"\bhat(e|ed)\b", "i"), ["I HATE it", "xhate", "hated.", "éhate", "hatee"]), (Rx(r"ignore\s+previous", "i"), ["Ignore  PREVIOUS", "ignore", "previous ignore"]),
        (Rx(r"says?\s*:"), ["say:", "says :", "sa:"]), (Rx(r"a+bc?d"), ["aabd", "abcd", "acd"]), (Rx("x{0,2}yes"), ["yes", "xyes", "no"]), (Rx(r"\bs?foo\b"), ["sfoo", "foo", " foo", "xfoo"]),
        (Rx(r"\b\d{3}-\d{2}\b"), ["123-45", "1123-45", "123-456", "a123-45"]), (Rx("abc|xyz"), ["xyz", "abc", "ab"]),
    ],
)
def test_gates_and_boundaries_change_nothing(spark, rx, texts):
    import re

    flags = re.A | (re.I if "i" in rx.flags else 0)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(rx.test(F.col("t"), F.lower("t")).alias("x"), rx.count(F.col("t"), F.lower("t")).alias("n")).collect()
    assert [r.x for r in got] == [bool(re.search(rx.source, t, flags)) for t in texts]
    assert [r.n > 0 for r in got] == [r.x for r in got]
