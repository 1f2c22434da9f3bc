"""Checks of streamed texts after every part, live or in batch, in time and state that do not grow with the text.

A check of a whole text looks for phrases and patterns and measures the text.  ``StreamCheck`` says which, and decides from
what has been seen so far; a scanner carries its automata's states from part to part, so that no part is read twice.
Decisions are those of the Column checks over the text so far (``output_checks``), which tests hold them against.

Two readings of a stream are told apart.  ``stop``: the first part after which a check of at least ``severity`` triggers is
replaced by an error and ends the stream.  ``progressive``: every part passes and violations are recorded; only a stop
condition ends the stream, replacing the part by a notice or passing it on.

Defined cases: a null delta is empty text; parts whose ``type`` is not ``text-delta`` pass uncounted until the stream ends; parts of
equal ``seq`` are taken in any order; rows without ``stream_id`` are one stream; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from bulwark.functions.regex import Rx, literal
from bulwark.functions.result import SEVERITIES
from bulwark.operators import output_checks as oc
from bulwark.streaming.automaton import count_words, scanner

#: Milliseconds without parts after which a live stream's state goes.
IDLE = 3_600_000

Verdict = tuple[str, str] | None
#: Characters beyond this one are two UTF-16 units.
BMP = chr(0xFFFF)


@dataclass(frozen=True)
class Seen:
    """What a text holds so far."""

    found: frozenset[str | Rx]
    length: int
    words: int

    def some(self, of) -> list:
        return [x for x in of if x in self.found]

    @property
    def tokens(self) -> int:
        """A quarter of the characters plus half of the words, rounded up."""
        return -(-(self.length + 2 * self.words) // 4)


@dataclass(frozen=True)
class StreamCheck:
    """``decide`` gives severity and message where the check triggers; ``phrases`` are in lower case and found in any case."""

    name: str
    decide: Callable[[Seen], Verdict]
    phrases: tuple[str, ...] = ()
    patterns: tuple[Rx, ...] = ()


# The checks of responses that hang on what occurs in a text and how long it is.


def max_length(limit: int) -> StreamCheck:
    return StreamCheck("output-length-limit", lambda s: ("medium", f"Output length {s.length} exceeds limit of {limit}") if s.length > limit else None)


def min_length(least: int) -> StreamCheck:
    return StreamCheck("min-length-requirement", lambda s: ("medium", f"Output length {s.length} below minimum of {least}") if s.length < least else None)


def token_limit(most: int) -> StreamCheck:
    """More estimated tokens than ``most``."""
    return StreamCheck("token-limit", lambda s: ("high", f"{s.tokens} tokens exceed limit of {most}") if s.tokens > most else None)


def blocked_content(words: list[str]) -> StreamCheck:
    def decide(s: Seen) -> Verdict:
        hit = next((w for w in words if w.lower() in s.found), None)
        return ("high", f"Blocked content detected: {hit}") if hit is not None else None

    return StreamCheck("blocked-content", decide, tuple(w.lower() for w in words))


def sensitive_data() -> StreamCheck:
    def decide(s: Seen) -> Verdict:
        kinds = [n for n, (rx, _) in oc.SENSITIVE.items() if rx in s.found]
        return (max((oc.SENSITIVE[n][1] for n in kinds), key=SEVERITIES.index), f"Sensitive data detected: {', '.join(kinds)}") if kinds else None

    return StreamCheck("sensitive-data-filter", decide, patterns=tuple(rx for rx, _ in oc.SENSITIVE.values()))


def confidence_threshold(least: float) -> StreamCheck:
    def decide(s: Seen) -> Verdict:
        score = 0.5 if s.some(oc.DOUBTS) else 0.9
        return ("medium", f"Output confidence {score} below threshold {least}") if score < least else None

    return StreamCheck("confidence-threshold", decide, tuple(oc.DOUBTS))


def toxicity_filter(threshold: float = 0.7) -> StreamCheck:
    return StreamCheck("toxicity-filter", lambda s: ("high", "Content toxicity score exceeds threshold") if len(s.some(oc.TOXIC)) * 0.3 > threshold else None, tuple(oc.TOXIC))


def hallucination_detector(threshold: float = 0.7) -> StreamCheck:
    def decide(s: Seen) -> Verdict:
        score = len(s.some(oc.HEDGES)) * 0.3 + len(s.some(oc.CLAIMS)) * 0.2
        return ("high" if score > 0.8 else "medium", "Potential hallucination detected") if score > threshold else None

    return StreamCheck("hallucination-detector", decide, (*oc.HEDGES, *oc.CLAIMS))


def bias_detector() -> StreamCheck:
    def decide(s: Seen) -> Verdict:
        kinds = [c for c, phrases in oc.BIAS.items() if s.some(phrases)]
        return ("medium", f"Potential bias detected in categories: {', '.join(kinds)}") if kinds else None

    return StreamCheck("bias-detector", decide, tuple(p for phrases in oc.BIAS.values() for p in phrases))


def factual_accuracy(require_sources: bool = False) -> StreamCheck:
    def decide(s: Seen) -> Verdict:
        return ("medium", "Factual claims detected without sources") if require_sources and s.some(oc.ACCURACY_CLAIMS) and not s.some(oc.CITATIONS) else None

    return StreamCheck("factual-accuracy-checker", decide, (*oc.ACCURACY_CLAIMS, *oc.CITATIONS))


def privacy_leakage() -> StreamCheck:
    def decide(s: Seen) -> Verdict:
        kinds = [c for c, rx in oc.PRIVACY.items() if rx in s.found]
        return ("critical", f"Potential privacy leakage detected: {', '.join(kinds)}") if kinds else None

    return StreamCheck("privacy-leakage-detector", decide, patterns=tuple(oc.PRIVACY.values()))


def compliance(regulations: list[str]) -> StreamCheck:
    known = {r.upper(): oc.REGULATIONS[r.lower()] for r in regulations if r.lower() in oc.REGULATIONS}

    def decide(s: Seen) -> Verdict:
        broken = [r for r, phrases in known.items() if s.some(phrases)]
        return ("high", f"Potential compliance violations detected: {', '.join(broken)}") if broken else None

    return StreamCheck("compliance-checker", decide, tuple(p for phrases in known.values() for p in phrases))


def secret_detector() -> StreamCheck:
    """Formats of secrets that have occurred; how often is not counted."""

    def decide(s: Seen) -> Verdict:
        kinds = [n for n, rx in oc.SECRETS.items() if rx in s.found]
        return ("critical", f"Output contains potential secret(s): {', '.join(kinds)}") if kinds else None

    return StreamCheck("secret-redaction", decide, patterns=tuple(oc.SECRETS.values()))


def unsafe_content() -> StreamCheck:
    """Categories that have occurred; how often is not counted."""

    def decide(s: Seen) -> Verdict:
        kinds = [c for c, rxs in oc.UNSAFE.items() if s.some(rxs)]
        return ("high", f"Unsafe content detected: {', '.join(kinds)}") if kinds else None

    return StreamCheck("unsafe-content-detector", decide, patterns=tuple(rx for rxs in oc.UNSAFE.values() for rx in rxs))


#: A stream's state: automata, what has been found, measures, parts checked or not, violating parts by severity, and whether it ended.
STATE = "raw array<int>, low array<int>, found array<int>, length bigint, words bigint, inside boolean, parts bigint, violations array<bigint>, stopped boolean"
FRESH = ([], [], [], 0, 0, False, 0, [0, 0, 0, 0], False)
OUT = "stream_id string, seq bigint, delta string, error string, violations array<string>"


@dataclass(frozen=True)
class Monitor:
    """How a stream is watched.

    ``every``: check after every so many text parts.  ``mode``: ``stop`` or ``progressive``.  ``severity``: what stops in the former.
    ``until`` ends a progressive stream: True (two violating parts, or a critical one), a number of them, or a test of their
    counts by severity (low to critical).  ``replace``: the part it ends with becomes a notice.
    """

    checks: tuple[StreamCheck, ...]
    every: int = 1
    mode: str = "stop"
    severity: str = "critical"
    until: bool | int | Callable[[list[int]], bool] = False
    replace: bool = True

    def __post_init__(self):
        if self.mode not in ("stop", "progressive") or self.severity not in SEVERITIES or self.every < 1:
            raise ValueError("unknown mode or severity, or checks after no parts at all")

    def _ends(self, verdicts: list[tuple[str, Verdict]], counts: list[int]) -> bool:
        if self.mode == "stop":
            return any(SEVERITIES.index(v[0]) >= SEVERITIES.index(self.severity) for _, v in verdicts)
        if self.until is True:
            return sum(counts) >= 2 or counts[3] > 0
        return self.until(counts) if callable(self.until) else bool(self.until) and sum(counts) >= self.until

    def reader(self) -> Callable[[tuple, str | None, bool], tuple[tuple, tuple | None]]:
        """A function of a stream's state and its next part that gives the state after it, and ``delta, error, violations`` of what passes on."""
        phrases = tuple(dict.fromkeys(p for c in self.checks for p in c.phrases))
        patterns = tuple(dict.fromkeys(p for c in self.checks for p in c.patterns))
        low_scan, raw_scan = scanner(tuple(Rx(literal(p)) for p in phrases)), scanner(patterns)
        every = (*phrases, *patterns)

        def bits(n: int, shift: int) -> set[int]:
            return {k + shift for k in range(n.bit_length()) if n >> k & 1}

        def read(state: tuple, delta: str | None, text: bool) -> tuple[tuple, tuple | None]:
            raw, low, found, length, words, inside, parts, counts, stopped = state
            if stopped:
                return state, None
            if not text:
                return state, (delta, None, [])
            said = delta or ""
            raw, sure, now = raw_scan.scan(raw, said)
            low, low_sure, low_now = low_scan.scan(low, said.lower())
            kept = {*found, *bits(low_sure, 0), *bits(sure, len(phrases))}
            n, inside = count_words(said, inside)
            length, words, parts = length + len(said) + sum(c > BMP for c in said), words + n, parts + 1
            state = (raw, low, sorted(kept), length, words, inside, parts, counts, False)
            if parts % self.every:
                return state, (delta, None, [])
            seen = Seen(frozenset(every[k] for k in kept | bits(low_now, 0) | bits(now, len(phrases))), length, words)
            verdicts = [(c.name, v) for c in self.checks if (v := c.decide(seen))]
            if not verdicts:
                return state, (delta, None, [])
            names, said_of = [name for name, _ in verdicts], ", ".join(v[1] for _, v in verdicts)
            counts = [*counts]
            counts[max(SEVERITIES.index(v[0]) for _, v in verdicts)] += 1
            ends = self._ends(verdicts, counts)
            state = (raw, low, sorted(kept), length, words, inside, parts, counts, ends)
            if ends and self.mode == "stop":
                return state, (None, f"Guardrail violation: {said_of}", names)
            if ends and self.replace:
                return state, (f"[Output blocked: {said_of}]", None, names)
            return state, (delta, None, names)

        return read


def _columns(parts: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("type") == "text-delta", F.lit(False)) if "type" in parts.columns else F.lit(True)
    return parts.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("bigint").alias("seq"), F.col("delta").cast("string").alias("delta"), text.alias("text"))


NAMES = ["stream_id", "seq", "delta", "error", "violations"]


def checked_parts(parts: DataFrame, monitor: Monitor) -> DataFrame:
    """``stream_id, seq, delta, error, violations`` of what passes, over a table of parts: one sort, then one pass that holds one stream's state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, at, state = monitor.reader(), None, FRESH
        for batch in batches:
            out = []
            for stream, seq, delta, text in zip(batch["stream_id"], batch["seq"], batch["delta"], batch["text"]):
                if (stream,) != at:
                    at, state = (stream,), FRESH
                state, passed = read(state, delta, text)
                if passed:
                    out.append((stream, seq, *passed))
            yield pd.DataFrame(out, columns=NAMES)

    ordered = _columns(parts).repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    return ordered.mapInPandas(run, OUT)


class _Watched(StatefulProcessor):
    """One live stream's state, dropped once ``IDLE`` has passed without parts."""

    def __init__(self, monitor: Monitor, idle_ms: int):
        self.monitor, self.idle_ms = monitor, idle_ms
        self.schema = StructType.fromDDL(STATE)  # by the driver: workers have no session to parse it

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.schema, self.idle_ms)
        self.read = self.monitor.reader()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else FRESH
        out = []
        for seq, delta, text in sorted((r for batch in rows for r in zip(batch["seq"].tolist(), batch["delta"], batch["text"])), key=lambda r: r[0]):
            state, passed = self.read(state, delta, bool(text))
            if passed:
                out.append((key[0], seq, *passed))
        self.state.update(state)
        yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def checked_stream(parts: DataFrame, monitor: Monitor, idle_ms: int = IDLE) -> DataFrame:
    """The same over a live stream of parts; across micro-batches the source must deliver a stream's parts in order.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    return _columns(parts).groupBy("stream_id").transformWithStateInPandas(_Watched(monitor, idle_ms), OUT, "Append", "ProcessingTime")
