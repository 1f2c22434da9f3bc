"""The uniform result of a check, and severities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities in ascending order.
SEVERITIES = ["low", "medium", "high", "critical"]
RESULT = (
    "struct<guardrail_name:string,triggered:boolean,execution_failed:boolean,severity:string,message:string,"
    "suggestion:string,confidence:double,metadata:map<string,string>>"
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once a row and hand it to ``use``; a costly expression used many times would be inlined many times."""
    return F.transform(F.array(value), use)[0]


def lowered(text: Column, use: Callable[[Column, Column], Column]) -> Column:
    """Hand the text, and the text in lower case, to ``use``; both are made once a row."""
    return let(F.struct(text.alias("raw"), F.lower(text).alias("lower")), lambda t: use(t["raw"], t["lower"]))


def text_of(value) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(None if value is None else str(value)).cast("string")


def result(
    name: str, triggered: Column, severity: str | Column = "medium", message: str | Column | None = None, suggestion: str | None = None,
    confidence: Column | None = None, failed: Column | None = None, **metadata: Column | str | int | float | None,
) -> Column:
    """A result struct; a null test counts as not triggered, and a message is kept only when it triggers."""
    triggered = F.coalesce(triggered, F.lit(False))
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), text_of(v))]
    return F.struct(
        F.lit(name).alias("guardrail_name"), triggered.alias("triggered"), (F.lit(False) if failed is None else failed).alias("execution_failed"),
        text_of(severity).alias("severity"), F.when(triggered, text_of(message)).alias("message"), F.when(triggered, text_of(suggestion)).alias("suggestion"),
        (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence"),
        (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("metadata"),
    ).cast(RESULT)


def rank(severity: Column) -> Column:
    """0 for low to 3 for critical; medium if missing."""
    out = F.lit(1)
    for k, s in enumerate(SEVERITIES):
        out = F.when(severity == s, k).otherwise(out)
    return out


def severity_of(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)


def risk(severity: Column) -> Column:
    """A quarter for low to one for critical."""
    return (rank(severity) + 1) / F.lit(4.0)


def highest(severities: Column) -> Column:
    """The highest of an array of severities; null if empty."""
    return F.when(F.size(severities) > 0, severity_of(F.array_max(F.transform(severities, rank))))


def failed_closed(name: str, message: str | Column) -> Column:
    """What a check that raised becomes on the fail-closed path."""
    return result(name, F.lit(True), "critical", message, error=message)


def failed_open(name: str, message: str | Column) -> Column:
    """What a check that raised becomes on the fail-open path."""
    return result(name, F.lit(False), "high", failed=F.lit(True), error=message)


def passed(name: str, **metadata) -> Column:
    return result(name, F.lit(False), **metadata)


def with_fields(struct: Column, **fields: Column) -> Column:
    for k, v in fields.items():
        struct = struct.withField(k, v)
    return struct
