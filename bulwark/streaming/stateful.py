"""The same over Structured Streaming: state by key, bounded by a watermark or an idle timeout.

Rows of a key are ordered within a micro-batch; across batches the source must deliver them in order.  State holds a few
numbers a key (for texts, what an automaton over the patterns carries), and leaves after ``IDLE`` without rows.  Idle timeouts make Spark plan batches
without data for as long as a query runs: with ``availableNow`` set ``spark.sql.streaming.noDataMicroBatches.enabled`` to false.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bulwark.streaming.checked import FRESH, STATE, Monitor, StreamCheck, token_limit

#: Milliseconds without rows after which a key's state goes.
IDLE = 3_600_000


def _keep(state: GroupState, values: tuple) -> None:
    state.update(values)
    state.setTimeoutDuration(IDLE)


def rate_limits(requests: DataFrame, limit: int, window_s: float = 60) -> DataFrame:
    """Requests (``key, micros``) with ``count, limited``: fixed windows anchored at a key's first request."""
    window = int(window_s * 1_000_000)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat([*batches]).sort_values("micros", kind="stable")
        start, count = state.get if state.exists else (None, 0)
        counts = []
        for t in rows["micros"]:
            if start is None or t - start > window:
                start, count = int(t), 0
            count += 1
            counts.append(count)
        _keep(state, (start, count))
        yield pd.DataFrame({"key": key[0], "micros": rows["micros"], "count": counts, "limited": [c > limit for c in counts]})

    return requests.groupBy("key").applyInPandasWithState(fold, "key string, micros long, count long, limited boolean", "start long, count long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def stopping_stream(parts: DataFrame, keywords: list[str], max_tokens: int | None = None) -> DataFrame:
    """Parts (``stream_id, seq, delta``) until a keyword, or more than ``max_tokens`` tokens, stand in the text so far.

    State is what an automaton over the keywords carries, and two counters; the text itself is not kept.
    """
    words = StreamCheck("keywords", lambda s: ("critical", "keyword") if s.found else None, tuple(k.lower() for k in keywords))
    monitor = Monitor((words, *([token_limit(max_tokens)] if max_tokens is not None else [])), severity="high")

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        read, held, keep = monitor.reader(), tuple(state.get) if state.exists else FRESH, []
        rows = pd.concat([*batches]).sort_values("seq", kind="stable")
        for delta in rows["delta"]:
            held, passed = read(held, delta, True)
            keep.append(passed is not None and passed[1] is None)
        _keep(state, held)
        yield rows.loc[keep, ["stream_id", "seq", "delta"]]

    return parts.groupBy("stream_id").applyInPandasWithState(fold, "stream_id string, seq long, delta string", STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def budgets(steps: DataFrame, max_cost: float) -> DataFrame:
    """Steps (``key, seq, cost``) with ``total, stopped``; once stopped, a key stays so."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat([*batches]).sort_values("seq", kind="stable")
        (total,) = state.get if state.exists else (0.0,)
        rows["total"] = rows["cost"].cumsum() + total
        rows["stopped"] = (rows["total"] > max_cost).cummax() | (total > max_cost)
        _keep(state, (float(rows["total"].iloc[-1]),))
        yield rows[["key", "seq", "cost", "total", "stopped"]]

    return steps.groupBy("key").applyInPandasWithState(fold, "key string, seq long, cost double, total double, stopped boolean", "total double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def violation_windows(violations: DataFrame, seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """Violations (``key, ts``) by tumbling event-time window; rows later than ``late`` are dropped."""
    return violations.withWatermark("ts", late).groupBy("key", F.window("ts", f"{seconds} seconds")).agg(F.count("*").alias("violations")).select("key", F.col("window.start").alias("start"), "violations")
