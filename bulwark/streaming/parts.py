"""Transforms of streamed text, over rows ``stream_id, seq, delta``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bulwark.functions import text as tx
from bulwark.functions.regex import SPACE, Rx, literal
from bulwark.streaming.checked import Monitor, StreamCheck, checked_parts

#: Personal data that streams redact, in the order it is redacted.
REDACTED = {
    "SSN": Rx(r"\b\d{3}-\d{2}-\d{4}\b"),
    "EMAIL": Rx(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    "PHONE": Rx(r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
    "CREDIT_CARD": Rx(r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
}


def redacted(delta: Column, kinds: list[str] | None = None, by: str = "[REDACTED]") -> Column:
    """Personal data replaced part by part, without state: works on any streaming DataFrame."""
    for kind in kinds or REDACTED:
        delta = REDACTED[kind].replace(delta, by)
    return delta


def accumulated(parts: DataFrame) -> DataFrame:
    """``parts`` with ``so_far``, the text up to and with each."""
    w = W.partitionBy("stream_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return parts.withColumn("so_far", F.array_join(F.collect_list("delta").over(w), ""))


def stop_at(parts: DataFrame, bad: Column) -> DataFrame:
    """Parts before the first one where ``bad`` (over ``so_far``) holds; that one and all later ones are dropped, ``stopped`` tells."""
    w = W.partitionBy("stream_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    marked = accumulated(parts).withColumn("__stop", F.max(F.coalesce(bad, F.lit(False))).over(w))
    return marked.withColumn("stopped", F.max("__stop").over(W.partitionBy("stream_id"))).filter(~F.col("__stop")).drop("__stop", "so_far")


def every_kth(parts: DataFrame, bad: Column, k: int) -> DataFrame:
    """``stop_at`` with the test made at every ``k``-th part only."""
    n = F.row_number().over(W.partitionBy("stream_id").orderBy("seq"))
    return stop_at(parts.withColumn("__n", n), bad & (F.col("__n") % k == 0)).drop("__n")


def buffered(parts: DataFrame) -> DataFrame:
    """``stream_id, text``: whole texts, for checks made once at the end."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    return parts.groupBy("stream_id").agg(F.array_join(F.transform(ordered, lambda p: p["delta"]), "").alias("text"))


def measured(parts: DataFrame) -> DataFrame:
    """``parts`` with ``length`` (UTF-16 units), ``words`` and ``tokens`` of the text up to and with each, from sums of what each part adds."""
    w = W.partitionBy("stream_id").orderBy("seq")
    said = F.coalesce("delta", F.lit(""))
    tail = F.last(F.when(said != "", F.right(said, F.lit(1))), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    goes_on = F.coalesce(tail.rlike(f"[^{SPACE}]") & said.rlike(rf"\A[^{SPACE}]"), F.lit(False))
    out = parts.withColumn("__words", tx.count_words(said) - goes_on.cast("int"))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumns({"length": F.sum(tx.length16(said)).over(upto), "words": F.sum("__words").over(upto)}).drop("__words")
    return out.withColumn("tokens", F.ceil(F.col("length") / F.lit(4.0) + F.col("words") / F.lit(2.0)))


def ended(parts: DataFrame, over: DataFrame) -> DataFrame:
    """Parts before the first of ``over`` (``stream_id, seq``) of their stream; ``stopped`` tells which streams have one."""
    ends = over.groupBy("stream_id").agg(F.min("seq").alias("__end"))
    return parts.join(ends, "stream_id", "left").filter(F.col("__end").isNull() | (F.col("seq") < F.col("__end"))).withColumn("stopped", F.col("__end").isNotNull()).drop("__end")


def token_budget(parts: DataFrame, most: int, tokens=None) -> DataFrame:
    """Parts until the text holds more than ``most`` tokens; ``tokens`` of a whole text, as a Column, in place of the estimate."""
    if tokens:
        return stop_at(parts, tokens(F.col("so_far")) > most)
    return ended(parts, measured(parts).filter(F.col("tokens") > most).select("stream_id", "seq"))


def content_filter(parts: DataFrame, keywords: list[str], case_sensitive: bool = False) -> DataFrame:
    """Parts until a keyword stands in the text so far."""
    words = StreamCheck("content-filter", lambda s: ("critical", "keyword") if s.found else None, *([(), tuple(Rx(literal(k)) for k in keywords)] if case_sensitive else [tuple(k.lower() for k in keywords)]))
    return ended(parts, checked_parts(parts, Monitor((words,))).filter(F.col("error").isNotNull()))


def token_aware_checks(parts: DataFrame, every: int = 10, tokens=None) -> DataFrame:
    """``checked``: whether a check falls due at a part, ``every`` tokens after the last one (a fold, as each check resets the count)."""
    counted = (accumulated(parts).withColumn("__t", tokens(F.col("so_far"))) if tokens else measured(parts).withColumn("__t", F.col("tokens"))).select(*parts.columns, "__t")
    schema = parts.schema.simpleString()[len("struct<") : -1] + ",checked:boolean"

    def fold(rows):
        rows = rows.sort_values("seq")
        last, out = 0, []
        for t in rows.pop("__t"):
            out.append(t - last >= every)
            last = t if out[-1] else last
        rows["checked"] = out
        return rows

    return counted.groupBy("stream_id").applyInPandas(fold, schema)


def handled(parts: DataFrame, bad: Column, on_violation: str = "stop", replacement: str = "[FILTERED]", patterns: list[Rx] = ()) -> DataFrame:
    """Parts that violate: the stream stops, or they are dropped, replaced, or redacted by the patterns."""
    if on_violation == "stop":
        return stop_at(parts, bad)
    marked = accumulated(parts).withColumn("__bad", F.coalesce(bad, F.lit(False))).drop("so_far")
    if on_violation == "drop":
        return marked.filter(~F.col("__bad")).drop("__bad")
    changed = F.col("delta")
    if on_violation == "redact":
        for rx in patterns:
            changed = rx.replace(changed, replacement)
    else:
        changed = F.lit(replacement)
    return marked.withColumn("delta", F.when(F.col("__bad"), changed).otherwise(F.col("delta"))).drop("__bad")
