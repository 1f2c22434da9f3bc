"""Generate, validate, and generate again what failed: a fixpoint over a shrinking set of rows.

Each round generates outputs for the rows that are left, checks them, and is written as a table; rows that pass are final.  Only rows
that are blocked go round again, with parameters adjusted to what blocked them, so a row is never generated twice for one
attempt, whatever happens to executors later.  Every row keeps its number of attempts, the delays it asked for and why
each attempt failed.

Defined cases: rows that repeat are rows of their own; a null output is an empty text to the checks; an error that may not be retried
ends a row at once, with ``failed`` set; no rows give no rows; columns of the same names as those added are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.errors import ExecutionFailed
from bulwark.functions.backoff import Delay
from bulwark.functions.backoff import none as no_delay
from bulwark.functions.result import let
from bulwark.operators import engine
from bulwark.operators.check import Check, Scope
from bulwark.sources.checkpoints import Written

Step = Callable[[DataFrame], DataFrame]
HISTORY = "array<struct<attempt:int,blocked:boolean,message:string,wait_ms:double>>"


def retried(
    rows: DataFrame, generate: Step, checks: list[Check], *, max_retries: int = 1, adjust: Step | None = None, backoff: Delay | float | None = None,
    retry_errors: Callable[[Column, Column], Column] | None = None, exhausted: str = "return-last", pause: Callable[[float], None] | None = None,
) -> DataFrame:
    """``rows`` with ``output, attempts, blocked, failed, message, waited_ms, history``.

    ``generate`` adds ``output`` and, where generation may fail, ``error`` (null if it did not); it sees ``attempt`` (from 0).
    ``adjust`` changes the parameters of rows that go round again; it sees ``output``, ``message`` and ``suggestion`` of the last attempt.
    ``backoff`` is a delay in milliseconds, or one by number of the retry; it is recorded, and ``pause`` (such as a sleep) gets
    the longest of each round.  ``retry_errors`` of error and attempt says which errors go round again: none by default.
    ``exhausted`` ``throw`` ends with an error if any row is still blocked after the last attempt.
    """
    if exhausted not in ("return-last", "throw") or max_retries < 0:
        raise ValueError("exhausted is return-last or throw, and retries are not negative")
    delay = backoff if callable(backoff) else no_delay() if backoff is None else (lambda n, ms=float(backoff): F.lit(ms) + n * 0)
    added = {"output": "string", "error": "string", "message": "string", "suggestion": "string"}
    pending = rows.drop(*added, "attempts", "blocked", "failed", "waited_ms", "history", "attempt")
    columns = pending.columns
    pending = pending.withColumns({n: F.lit(None).cast(t) for n, t in added.items()} | {"history": F.array().cast(HISTORY)})
    tables, schema = Written(rows.sparkSession), None
    for attempt in range(max_retries + 1):
        number = F.lit(attempt)
        made = generate(pending.withColumns({"attempt": number, "__last": F.col("output"), "error": F.lit(None).cast("string")}))
        # bound in one struct, so that what generates is evaluated once; an attempt that failed leaves the last result in place
        last = F.when(F.col("error").isNotNull(), F.col("__last")).otherwise(F.col("output"))
        made = made.withColumn("__made", let(F.struct(last.alias("output"), F.col("error").alias("error")), lambda m: m)).drop("__last", "attempt", "output", "error", "message", "suggestion")
        results = engine.run(checks, Scope(F.coalesce("__made.output", F.lit(""))))
        judged = made.withColumn("__judged", let(let(results, engine.summary), lambda s: F.struct(
            (s["blocked"] > 0).alias("blocked"), F.array_join(F.transform(s["blocked_results"], lambda r: F.coalesce(r["message"], F.lit("blocked"))), ", ").alias("said"), engine.retry_instruction(s).alias("suggestion"),
        )))
        error = F.col("__made.error")
        again = F.coalesce(retry_errors(error, number), F.lit(False)) if retry_errors else F.lit(False)
        missing = error.isNotNull()
        blocked = missing | F.col("__judged.blocked")
        judged = judged.withColumns({
            "output": F.col("__made.output"), "failed": missing & ~again, "blocked": blocked, "message": F.when(missing, F.concat(F.lit("Generation error: "), error)).when(blocked, F.col("__judged.said")),
            "suggestion": F.when(~missing & blocked, F.col("__judged.suggestion")),
        })
        wait = (delay(number) if attempt else F.lit(0.0)).cast("double")
        entry = F.struct(number.alias("attempt"), F.col("blocked"), F.col("message"), wait.alias("wait_ms"))
        judged = judged.withColumn("history", F.concat("history", F.array(entry)).cast(HISTORY)).drop("__judged", "__made")
        goes_on = F.col("blocked") & ~F.col("failed") & F.lit(attempt < max_retries)
        done = tables.write(judged.withColumn("__again", goes_on), f"round={attempt}", "__again")
        schema = done.schema
        if attempt:
            tables.drop(f"round={attempt - 1}", "__again=true")  # what went round again is in this round's table
        pending = done.filter("__again").drop("__again")
        if pending.isEmpty():
            break
        if pause:
            pause(pending.select(F.max(delay(F.lit(attempt + 1)).cast("double"))).first()[0])
        pending = adjust(pending) if adjust else pending
        pending = pending.drop("blocked", "failed")
    out = reduce(DataFrame.unionByName, [tables.read(f"round={k}", schema).filter("NOT __again") for k in range(attempt + 1)])
    out = out.select(*columns, "output", F.size("history").alias("attempts"), "blocked", "failed", "message", F.aggregate(F.transform("history", lambda h: h["wait_ms"]), F.lit(0.0), lambda a, x: a + x).alias("waited_ms"), "history")
    if exhausted == "throw" and (bad := out.filter("blocked").select("attempts", "message").head()):
        raise ExecutionFailed(f"Retry exhausted after {bad['attempts'] - 1} attempts: {bad['message']}")
    return out


# Adjustments of a retry's parameters.


def more_tokens(by: int = 200, column: str = "max_output_tokens") -> Step:
    """More output tokens, 400 at least."""
    return lambda df: df.withColumn(column, engine.increased_tokens(F.col(column), by))


def encouraged(words: str = "Please provide a more detailed and comprehensive response.", column: str = "prompt") -> Step:
    """The prompt with a note on what was blocked, and a word of encouragement."""
    note = F.when(F.col("message").isNotNull(), F.concat(F.lit("Note: "), F.col("message"), F.lit("."))).otherwise("")
    return lambda df: df.withColumn(column, F.concat(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit("\n"), note, F.lit(f" {words}")))


def improved(by: int = 200, words: str | None = None) -> Step:
    """Both."""
    encourage = encouraged(words) if words else encouraged()
    return lambda df: encourage(more_tokens(by)(df))


def instructed(column: str = "prompt") -> Step:
    """The prompt with the suggestions of the checks that blocked."""
    return lambda df: df.withColumn(column, F.concat_ws("\n", F.col(column).cast("string"), F.col("suggestion")))
