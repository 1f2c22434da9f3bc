"""Folds over the ordered rows of a key, split even where one key holds most rows.

The rows are sorted over the whole cluster and cut in *pieces* of at most ``2 ** SHIFT`` consecutive rows, so a busy key spans
many pieces.  A fold then runs in three steps, none of which holds more than a piece's times:

1. every piece that a key enters or leaves is summarised, in parallel, as a *table*: what the fold's state is at the end of
   the piece, for every state it may be entered with.  A table is a step function of one number and has few steps;
2. the tables of a key are read in order, which gives the state that each of its pieces is entered with: one lookup a piece;
3. every piece is folded from that state, in parallel.

So the sequential part reads tables only.  Results do not hang on where pieces are cut.  Rows pass through as Arrow batches:
columns of any type come out as they went in.  Rows without a time take no part in a fold and get nulls; rows of a null key
are one key; rows of one moment are taken in the order given, else in any.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from bulwark.sources.checkpoints import checkpointed

#: Pieces have at most two to this power rows.
SHIFT = 16
LOWEST = -(1 << 62)


@dataclass
class Table:
    """A step function: from ``lows[k]`` on, up to the next, ``a[k]`` and ``b[k]`` say what comes out."""

    lows: list[int]
    a: list[int]
    b: list[int]


class Anchored:
    """Windows anchored at their first event: a new one begins with the first event more than ``window`` after the last began.

    The state is the window's start and its events so far.  ``inclusive`` begins one at exactly the window's length, too.
    """

    outputs = "window_start bigint, count bigint"
    #: In place of a window's start: the one that the piece was entered with.
    KEPT = LOWEST

    def __init__(self, window: int, inclusive: bool = False):
        self.window, self.side = window, "left" if inclusive else "right"

    def _beyond(self, times: np.ndarray, start):
        """The first event that lies beyond windows begun at ``start``."""
        return np.searchsorted(times, start + self.window, self.side)

    def run(self, times: np.ndarray, state: list[int] | None) -> tuple[list[int], list[np.ndarray]]:
        n = len(times)
        beyond = self._beyond(times, times)
        starts, counts = np.empty(n, np.int64), np.arange(1, n + 1)
        at = 0
        if state:
            at = min(int(self._beyond(times, state[0])), n)
            starts[:at] = state[0]
            counts[:at] += state[1]
        marks = []
        while at < n:
            marks.append(at)
            at = int(beyond[at])
        if marks:
            lengths = np.diff([*marks, n])
            starts[marks[0] :] = np.repeat(times[marks], lengths)
            counts[marks[0] :] -= np.repeat(marks, lengths)
        return [int(starts[-1]), int(counts[-1])], [starts, counts]

    def enter(self, state: list[int] | None, first: int) -> int:
        return state[0] if state else LOWEST

    def table(self, times: np.ndarray) -> Table:
        """By the start of the window that reaches into the piece: start and count of the last window that begins in it, or ``KEPT`` and the piece's events."""
        n = len(times)
        follow = np.minimum(self._beyond(times, times), n)
        last = np.where(follow < n, follow, np.arange(n))
        while ((further := last[last]) != last).any():  # pointers doubled, to the last window after each event
            last = further
        # event k opens a window exactly if event k - 1 lies within the one before; none that reaches in began after the first event
        entries = min(int(follow[0]), n - 1)
        inclusive = int(self.side == "left")
        lows = [LOWEST, *(times[: entries + (entries == n - 1)] - self.window + inclusive).tolist()]
        ends = last[: entries + 1]
        a, b = times[ends].tolist(), (n - ends).tolist()
        if entries == n - 1:
            a.append(self.KEPT)
            b.append(n)
        keep = [k for k in range(len(a)) if k + 1 == len(a) or lows[k] != lows[k + 1]]  # of events of one moment, the last
        keep = [k for j, k in enumerate(keep) if j == 0 or (a[k], b[k]) != (a[keep[j - 1]], b[keep[j - 1]])]
        return Table([lows[k] for k in keep], [a[k] for k in keep], [b[k] for k in keep])

    def leave(self, table: Table, state: list[int] | None, entered: int, last: int) -> list[int]:
        k = bisect_right(table.lows, entered) - 1
        return [state[0], state[1] + table.b[k]] if table.a[k] == self.KEPT else [table.a[k], table.b[k]]


class Bucket:
    """A bucket of ``capacity`` tokens, refilled at ``rate`` a second, from which each event takes ``cost`` if there is as much.

    Everything is counted in whole numbers of a unit of which refills, cost and capacity are multiples; the state is what
    is left and when.  What is left after a piece, as a function of what is there at its first event, consists of a few
    intervals: each event shifts them, fills them up to the capacity, and splits the one around ``cost``.
    """

    outputs = "allowed boolean, tokens double"

    def __init__(self, rate: float, capacity: float, cost: float = 1.0):
        r, c, k = (Fraction(x).limit_denominator(10**6) for x in (rate, capacity, cost))
        if r < 0 or c <= 0 or k < 0:
            raise ValueError("rate and cost must not be negative, and the capacity positive")
        whole = int(np.lcm.reduce([r.denominator, c.denominator, k.denominator]))
        self.unit = whole * 1_000_000
        self.refill, self.capacity, self.cost = int(r * whole), int(c * self.unit), int(k * self.unit)
        if self.capacity >= 1 << 60 or self.cost >= 1 << 60:
            raise ValueError("too many tokens for the unit that the rate calls for")
        #: Pauses of this length fill the bucket, whatever was in it.
        self.full = self.capacity // self.refill + 1 if self.refill else 0

    def _refills(self, gaps: np.ndarray) -> np.ndarray:
        return np.minimum(gaps, self.full) * self.refill

    def run(self, times: np.ndarray, state: list[int] | None) -> tuple[list[int], list[np.ndarray]]:
        tokens, since = state or (self.capacity, int(times[0]))
        left, allowed, capacity, cost = [], [], self.capacity, self.cost
        for refill in self._refills(np.diff(times, prepend=since)).tolist():
            tokens = min(capacity, tokens + refill)
            ok = tokens >= cost
            if ok:
                tokens -= cost
            allowed.append(ok)
            left.append(tokens)
        return [tokens, int(times[-1])], [np.array(allowed), np.array(left) / self.unit]

    def enter(self, state: list[int] | None, first: int) -> int:
        """Tokens there are at the piece's first event."""
        return min(self.capacity, state[0] + int(self._refills(np.array([first - state[1]]))[0])) if state else self.capacity

    def table(self, times: np.ndarray) -> Table:
        """By the tokens there are at the first event: what is left for the least of an interval, and 1 where all it has more is left, too.

        Once many amounts have come to the same, the map goes on from what is left, and the parts are composed.
        """
        done: list[Line] = []
        lines: list[Line] = [(0, self.capacity + 1, 0, 1)]
        since = 0
        for refill in [0, *self._refills(np.diff(times)).tolist()]:
            lines = self._step(lines, refill)
            since += 1
            if since >= 32 and len(lines) > 8:
                done, since = _composed(done, lines), 0
                ends = [out + slope * (high - low - 1) for low, high, out, slope in lines]
                least = min(out for _, _, out, _ in lines)
                lines = [(least, max(ends) + 1, least, 1)]
        low, _, out, slope = zip(*_composed(done, lines))
        return Table([*low], [*out], [*slope])

    def _step(self, lines: list[Line], refill: int) -> list[Line]:
        """What one event makes of each line."""
        capacity, cost = self.capacity, self.cost
        stepped: list[Line] = []
        for low, high, out, slope in lines:
            out += refill
            parts = [(low, high, out, slope)]
            if out >= capacity:
                parts = [(low, high, capacity, 0)]
            elif slope and capacity - out < high - low:
                at = low + capacity - out
                parts = [(low, at, out, 1), (at, high, capacity, 0)]
            for low, high, out, slope in parts:
                if out >= cost:
                    _append(stepped, low, high, out - cost, slope)
                elif slope and cost - out < high - low:
                    at = low + cost - out
                    _append(stepped, low, at, out, 1)
                    _append(stepped, at, high, 0, 1)
                else:
                    _append(stepped, low, high, out, slope)
        return stepped

    def leave(self, table: Table, state: list[int] | None, entered: int, last: int) -> list[int]:
        k = bisect_right(table.lows, entered) - 1
        return [table.a[k] + table.b[k] * (entered - table.lows[k]), last]


#: From ``low`` to before ``high``, what comes out: at ``low``, and by how much it grows (0 or 1).
Line = tuple[int, int, int, int]


def _append(lines: list[Line], low: int, high: int, out: int, slope: int) -> None:
    """A further line; it becomes one with the last if it goes on from it."""
    if lines:
        a, _, b, s = lines[-1]
        if s == slope and out == b + s * (low - a):
            lines[-1] = (a, high, b, s)
            return
    lines.append((low, high, out, slope))


def _composed(first: list[Line], then: list[Line]) -> list[Line]:
    """``then`` after ``first``; none is the identity."""
    if not first:
        return then
    lows, lines = [line[0] for line in then], []
    for low, high, out, slope in first:
        k = bisect_right(lows, out) - 1
        while low < high:
            a, b, c, s = then[k]
            end = min(high, low + b - out) if slope else high
            _append(lines, low, end, c + s * (out - a), s * slope)
            out, low, k = out + slope * (end - low), end, k + 1
    return lines


class Recent:
    """Events of the last ``window``, the current one included and one at exactly that distance not: counted up to ``most``.

    The state is the times of the last ``most - 1`` events.
    """

    outputs = "recent bigint"

    def __init__(self, window: int, most: int):
        if most < 2:
            raise ValueError("count up to two at least")
        self.window, self.most = window, most

    def run(self, times: np.ndarray, state: list[int] | None) -> tuple[list[int], list[np.ndarray]]:
        before = np.array(state or [], np.int64)
        every = np.concatenate([before, times])
        at = np.arange(len(before), len(every))
        oldest = np.searchsorted(every, times - self.window, "right")
        return every[1 - self.most :].tolist(), [np.minimum(at - oldest + 1, self.most)]

    def enter(self, state: list[int] | None, first: int) -> int:
        return 0

    def table(self, times: np.ndarray) -> Table:
        return Table([0], times[1 - self.most :].tolist(), [])

    def leave(self, table: Table, state: list[int] | None, entered: int, last: int) -> list[int]:
        return [*(state or []), *table.a][1 - self.most :]


Fold = Anchored | Bucket | Recent


def runs_of(batch: pa.RecordBatch, columns: list[str]) -> list[tuple[int, int]]:
    """Bounds of the runs of equal ``columns`` in a batch."""
    begins = np.zeros(batch.num_rows, bool)
    begins[:1] = True
    for name in columns:
        codes = pc.dictionary_encode(batch.column(name), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        begins[1:] |= codes[1:] != codes[:-1]
    cuts = [*np.flatnonzero(begins).tolist(), batch.num_rows]
    return [*zip(cuts[:-1], cuts[1:])] if batch.num_rows else []


def _tables(cut: DataFrame, key: str, micros: str, fold: Fold) -> DataFrame:
    """``key, __piece, t0, t1, lows, a, b``: tables of every piece's first and last key; the others begin and end in it."""
    more = "__piece bigint, t0 bigint, t1 bigint, lows array<bigint>, a array<bigint>, b array<bigint>"
    types = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 3

    def summarised(runs: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        rows = []
        for value, piece, parts in runs[:1] + runs[1:][-1:]:
            times = np.concatenate(parts)
            table = fold.table(times)
            rows.append((value, piece, int(times[0]), int(times[-1]), table.lows, table.a, table.b))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [key_type, *types])], [key, "__piece", "t0", "t1", "lows", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple] = []  # the first and the latest key of the current piece, with the parts of their times
        key_type = None
        for batch in batches:
            column, key_type = batch.column(key), batch.column(key).type
            pieces, times = batch.column("__piece").to_numpy(), batch.column(micros).to_numpy()
            for begin, end in runs_of(batch, ["__piece", key]):
                value, piece = column[begin].as_py(), int(pieces[begin])
                if runs and runs[-1][1] != piece:
                    yield summarised(runs, key_type)
                    runs = []
                if runs and runs[-1][0] == value:
                    runs[-1][2].append(times[begin:end])
                else:
                    runs = [*runs[:1], (value, piece, [times[begin:end]])]
        if runs:
            yield summarised(runs, key_type)

    return cut.select(key, "__piece", F.col(micros).cast("long").alias(micros)).mapInArrow(run, StructType([cut.schema[key]]).simpleString()[7:-1] + ", " + more)


def _entered(tables: DataFrame, key: str, fold: Fold) -> DataFrame:
    """``key, __piece, __state``: the state that a piece is entered with, where a key goes on from the piece before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, state = None, None
        for batch in batches:
            column, out = batch.column(key), []
            for k, row in enumerate(batch.drop_columns([key]).to_pylist()):
                one = column[k].as_py()
                if state is not None and one == value:
                    out.append((one, row["__piece"], state))
                else:
                    value, state = one, None
                entered = fold.enter(state, row["t0"])
                state = fold.leave(Table(row["lows"], row["a"], row["b"]), state, entered, row["t1"])
            columns = [*zip(*out)] or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [column.type, pa.int64(), pa.list_(pa.int64())])], [key, "__piece", "__state"])

    ordered = tables.repartition(key).sortWithinPartitions(key, "__piece")
    return ordered.mapInArrow(run, StructType([tables.schema[key]]).simpleString()[7:-1] + ", __piece bigint, __state array<bigint>")


def folded(df: DataFrame, key: str, micros: str, fold: Fold, order: list[str] | None = None) -> DataFrame:
    """``df`` with the outputs of ``fold`` over the rows of each ``key`` by ``micros``, then ``order``."""
    order = [micros, *(c for c in order or [] if c != micros)]
    dated = df.filter(F.col(micros).isNotNull())
    # a row's piece comes from its place in the sorted partition; the written table keeps both
    cut = dated.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("__piece", F.shiftright(F.monotonically_increasing_id(), SHIFT))
    cut = checkpointed(cut)
    states = _entered(_tables(cut, key, micros, fold), key, fold)
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name != key]
    # states travel as text: a column of arrays, nearly all of them null, takes many times as long to turn into Arrow
    heads = states.select(key, *blank, "__piece", F.array_join("__state", " ").alias("__state"), F.lit(0).alias("__row"))
    rows = cut.withColumns({"__state": F.lit(None).cast("string"), "__row": F.lit(1)}).unionByName(heads)
    rows = rows.repartition("__piece").sortWithinPartitions("__piece", key, "__row", *order)
    added = StructType.fromDDL(fold.outputs)
    names = [f.name for f in df.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            column, pieces = batch.column(key), batch.column("__piece").to_numpy()
            events = batch.column("__row").to_numpy() == 1
            times = pc.fill_null(batch.column(micros).cast(pa.int64()), 0).to_numpy()
            parts: list[list[np.ndarray]] = [[] for _ in added]
            for begin, end in runs_of(batch, ["__piece", key]):
                here = (int(pieces[begin]), column[begin].as_py())
                if here != at:
                    at, state = here, None
                if not events[begin]:
                    state = [*map(int, batch.column("__state")[begin].as_py().split())]
                    begin += 1
                if begin < end:
                    state, out = fold.run(times[begin:end], state)
                    for p, o in zip(parts, out):
                        p.append(o)
            kept = batch.select(names).filter(pa.array(events))
            values = [pa.array(np.concatenate(p) if p else []) for p in parts]
            arrow = [pa.bool_() if f.dataType.simpleString() == "boolean" else pa.float64() if f.dataType.simpleString() == "double" else pa.int64() for f in added]
            yield pa.RecordBatch.from_arrays([*kept.columns, *(v.cast(t) for v, t in zip(values, arrow))], [*names, *added.names])

    out = rows.mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in (*df.schema, *added)]))
    undated = df.filter(F.col(micros).isNull()).withColumns({f.name: F.lit(None).cast(f.dataType) for f in added})
    return out.unionByName(undated)
