"""Gradual enforcement over a live stream of violations, and what its state says at any time.

A violation counts in a window anchored at the first one, as in ``sessions.escalated``.  The count lives in a state store; it can
be read from the stream's checkpoint by another job while the stream runs or after it has ended (``violation_stats``), and is
cleared by a row of the stream itself (``clear``), so that a restart or a lost executor replays the clearing, too.

Defined cases: rows of a key are taken by ``micros`` within a micro-batch, clearing before violations of the same moment; a null
severity counts, but under no severity; a key that was cleared, or whose window has passed, has no statistics.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from bulwark.functions.result import SEVERITIES

STATE = "start bigint, count bigint, " + ", ".join(f"{s} bigint" for s in SEVERITIES)
OUT = "key string, micros bigint, severity string, count bigint, phase string"


class _Enforced(StatefulProcessor):
    def __init__(self, warn: int, block: int, window_us: int):
        self.warn, self.block, self.window_us = warn, block, window_us
        self.schema = StructType.fromDDL(STATE)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("violations", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = list(self.state.get()) if self.state.exists() else None
        given = [r for batch in rows for r in zip(batch["micros"].tolist(), batch["severity"], batch["clear"])]
        out = []
        for micros, severity, clear in sorted(given, key=lambda r: (r[0], not r[2])):
            if clear:
                state = None
                continue
            if state is None or micros - state[0] > self.window_us:
                state = [micros, 0, *[0] * len(SEVERITIES)]
            state[1] += 1
            if severity in SEVERITIES:
                state[2 + SEVERITIES.index(severity)] += 1
            phase = "warn" if state[1] <= self.warn else "block" if state[1] > self.block else "warn-elevated"
            out.append((key[0], micros, severity, state[1], phase))
        if state is None:
            self.state.clear()
        else:
            self.state.update(tuple(state))
        yield pd.DataFrame(out, columns=["key", "micros", "severity", "count", "phase"])

    def close(self) -> None:
        pass


def enforced(violations: DataFrame, warn: int = 1, block: int = 2, window_s: float = 300) -> DataFrame:
    """A live stream of ``key, micros, severity`` and, where histories are to be cleared, ``clear``: violations with ``count`` and ``phase``.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    clear = F.coalesce(F.col("clear"), F.lit(False)) if "clear" in violations.columns else F.lit(False)
    rows = violations.select(F.col("key").cast("string").alias("key"), F.col("micros").cast("bigint").alias("micros"), "severity", clear.alias("clear"))
    return rows.groupBy("key").transformWithStateInPandas(_Enforced(warn, block, int(window_s * 1_000_000)), OUT, "Append", "None")


def violation_stats(spark: SparkSession, checkpoint: str, now_micros: int, window_s: float = 300) -> DataFrame:
    """``key, window_start, count`` and counts by severity, read from the state of the stream that checkpoints to ``checkpoint``.

    Windows that have passed at ``now_micros`` are left out.
    """
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "violations").load()
    out = state.select(F.col("key.key").alias("key"), "value.*").withColumnRenamed("start", "window_start")
    return out.filter(F.lit(now_micros) - F.col("window_start") <= int(window_s * 1_000_000))
