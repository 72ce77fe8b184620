"""Rolling statistics over rows that lie in order, computed on arrays as the rows pass.

``ordered`` deals rows by entity and sorts them once. What follows needs no window of the planner: each part streams through in Arrow
batches, a few whole entities at a time, and a frame of w rows is merged from the states of 1, 2, 4, ... rows, some 2 * log2(w) array
operations for all rows at once. A value rests on the rows of its own frame only, as in ``rolling``, and no digits cancel. Memory is
that of one batch and one entity (its rows are bounded by the calendar).
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from panelstone.functions.numeric import VAR_FLOOR
from panelstone.session import dealt

# The steps travel whole: workers need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Step:
    """One column to add: ``kind`` of ``x`` (and ``y``) over the last ``window`` rows, or the value that many rows back."""

    name: str
    kind: str
    x: str
    window: int
    need: int = 0
    y: str | None = None
    full: bool = False
    scale: float = 1.0


@dataclass(frozen=True)
class Ordered:
    """A frame whose parts hold whole entities, each in order, and the steps that wait for one pass over them.

    Columns are added and dropped as on a frame. Those that name a waiting step are left for after the pass; a step over one of them makes
    the steps before it run first.
    """

    frame: DataFrame
    by: list[str]
    order: str
    steps: tuple[Step, ...] = ()
    inputs: tuple[str, ...] = ()
    later: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    made: frozenset[str] = frozenset()

    def after(self, *steps: Step) -> Ordered:
        out = self.passed() if self.made & {x for s in steps for x in (s.x, s.y)} else self
        return replace(out, steps=(*out.steps, *steps))

    def passed(self) -> Ordered:
        """The waiting steps and what was left for after them as columns; the inputs made for the steps are gone."""
        if not self.steps:
            return self
        fields = [x for x in self.frame.schema.fields if x.name not in self.inputs]
        schema = StructType([*fields, *[StructField(s.name, DoubleType()) for s in self.steps]])
        out = self.frame.mapInArrow(walk(self.by, self.order, self.steps, schema.names), schema)
        return Ordered(reduce(lambda df, f: f(df), self.later, out), self.by, self.order)

    def _waits(self, columns: dict[str, Column]) -> bool:
        """Do these columns name a waiting step or what follows from one, or take the name of a column that is there?"""
        names = {s.name for s in self.steps} | self.made
        if set(columns) & (names | set(self.frame.columns)):
            return bool(self.steps)
        return any(re.search(rf"\b{re.escape(x)}\b", str(c)) for x in names for c in columns.values())

    def withColumns(self, columns: dict[str, Column]) -> Ordered:  # noqa: N802 - as on a frame
        if self._waits(columns):
            return replace(self, later=(*self.later, lambda df: df.withColumns(columns)), made=self.made | set(columns))
        return replace(self, frame=self.frame.withColumns(columns))

    def withColumn(self, name: str, column: Column) -> Ordered:  # noqa: N802
        return self.withColumns({name: column})

    def drop(self, *names: str) -> Ordered:
        if self.steps:
            return replace(self, later=(*self.later, lambda df: df.drop(*names)))
        return replace(self, frame=self.frame.drop(*names))

    def with_input(self, column: Column) -> tuple[Ordered, str]:
        """Add a column for the next steps only; also its name."""
        name = f"_x{len(self.inputs)}"
        out = self.passed() if self._waits({name: column}) else self
        return replace(out, frame=out.frame.withColumn(name, column), inputs=(*out.inputs, name)), name


def ordered(df: DataFrame, by: list[str], order: str, deal: bool = True) -> Ordered:
    """Deal rows by entity, into parts that grow in number with the files, and sort them once; ``deal=False`` if they are dealt."""
    return Ordered((dealt(df, *by) if deal else df).sortWithinPartitions(*by, order), by, order)


# ---- arrays


class Rows:
    """Columns of whole entities as arrays, and the place of each row in its entity."""

    def __init__(self, table: pa.Table, starts: np.ndarray):
        self.table, self.added = table, {}
        sizes = np.diff(np.append(starts, table.num_rows))
        self.place = np.arange(table.num_rows) - np.repeat(starts, sizes)
        self.kept: dict = {}

    def get(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Values (anything where null) and whether they are there."""
        if name not in self.added:
            column = self.table.column(name).combine_chunks()
            known = column.is_valid().to_numpy(zero_copy_only=False)
            self.added[name] = column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), known
        return self.added[name]

    def back(self, x: np.ndarray, n: int, empty) -> np.ndarray:
        """The value ``n`` rows before, ``empty`` where the entity has no such row."""
        if n == 0:
            return x
        out = np.full_like(x, empty)
        out[n:] = x[: max(len(x) - n, 0)]
        out[self.place < n] = empty
        return out

    def over(self, key: tuple, first: Callable[[], tuple], merge: Callable, empty: tuple, window: int) -> tuple:
        """The state of the last ``window`` rows. ``merge`` takes the earlier rows first; doubled states are kept under ``key``."""
        levels = self.kept.setdefault(key, [])
        if not levels:
            levels.append(first())
        moved = lambda state, n: tuple(self.back(x, n, e) for x, e in zip(state, empty))
        while 2 ** len(levels) <= window:
            levels.append(merge(moved(levels[-1], 2 ** (len(levels) - 1)), levels[-1]))
        out, done = None, 0
        for k in reversed(range(window.bit_length())):
            if window >> k & 1:
                piece = moved(levels[k], done)
                out = piece if out is None else merge(piece, out)
                done += 1 << k
        return out


def quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Zero where the divisor is: callers look at it themselves."""
    return np.divide(a, b, out=np.zeros_like(a), where=b != 0)


def added(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b))


def merged(a: tuple, b: tuple) -> tuple:
    """Count, sums and central moments: (n, x, xx) or (n, x, y, xy, yy)."""
    n = a[0] + b[0]
    weight = quotient(a[0] * b[0], n)
    apart = [quotient(v, b[0]) - quotient(u, a[0]) for u, v in zip(a[1:-1], b[1:-1])][: 1 if len(a) == 3 else 2]
    dx, dy = apart[0], apart[-1]
    if len(a) == 3:
        return n, a[1] + b[1], a[2] + b[2] + dx * dx * weight
    return n, a[1] + b[1], a[2] + b[2], a[3] + b[3] + dx * dy * weight, a[4] + b[4] + dy * dy * weight


def statistic(rows: Rows, s: Step) -> tuple[np.ndarray, np.ndarray]:
    """Sum, mean, rms, std, var_pop or beta of the finite values, with the gates of ``rolling``."""
    x, known = rows.get(s.x)
    known = known & np.isfinite(x)
    if s.y is not None:
        y, other = rows.get(s.y)
        known = known & other & np.isfinite(y)
        y = np.where(known, y, 0.0)
    x, one = np.where(known, x, 0.0), known.astype(float)
    zero = np.zeros_like(x)
    if s.kind == "beta":
        state = rows.over(("beta", s.x, s.y), lambda: (one, x, y, zero, zero), merged, (0.0,) * 5, s.window)
    elif s.kind in ("std", "var_pop"):
        state = rows.over(("moments", s.x), lambda: (one, x, zero), merged, (0.0,) * 3, s.window)
    else:
        state = rows.over(("sums", s.x), lambda: (one, x), added, (0.0,) * 2, s.window)
    n = state[0]
    there = n >= s.need
    if s.full:
        there &= rows.place + 1 >= s.window
    if s.kind == "sum":
        value = state[1]
    elif s.kind in ("mean", "rms"):
        there &= n > 0
        value = quotient(state[1], n)
        value = np.sqrt(np.maximum(value, 0.0)) if s.kind == "rms" else value
    elif s.kind == "std":
        there &= n >= 2
        value = np.sqrt(quotient(state[2], n - 1))
    elif s.kind == "var_pop":
        there &= n > 0
        value = quotient(state[2], n)
    elif s.kind == "beta":
        there &= quotient(state[4], n) > VAR_FLOOR
        value = quotient(state[3], state[4])
    else:
        raise ValueError(f"unknown rolling kind {s.kind!r}")
    return value * s.scale if s.scale != 1.0 else value, there


def extreme(rows: Rows, s: Step) -> tuple[np.ndarray, np.ndarray]:
    """Maximum or minimum of a full window of values; not-a-number is the greatest value."""
    x, known = rows.get(s.x)
    pick, empty = (np.maximum, -np.inf) if s.kind == "max" else (np.fmin, np.inf)
    merge = lambda a, b: (a[0] + b[0], pick(a[1], b[1]))
    n, best = rows.over((s.kind, s.x), lambda: (known.astype(float), np.where(known, x, empty)), merge, (0.0, empty), s.window)
    return best, n == s.window


def lower(a: tuple, b: tuple) -> tuple:
    """Peak, trough and worst ratio of a trough to a peak before it."""
    across = np.where((b[1] < np.inf) & (a[0] > -np.inf), b[1] / a[0], np.inf)
    return np.maximum(a[0], b[0]), np.minimum(a[1], b[1]), np.fmin(np.fmin(a[2], b[2]), across)


def drawdown(rows: Rows, s: Step) -> tuple[np.ndarray, np.ndarray]:
    x, known = rows.get(s.x)
    known = known & (x > 0)
    first = lambda: (np.where(known, x, -np.inf), np.where(known, x, np.inf), np.where(known, 1.0, np.inf))
    peak, _, worst = rows.over(("drawdown", s.x), first, lower, (-np.inf, np.inf, np.inf), s.window)
    return worst - 1.0, (rows.place + 1 >= s.window) & (peak > -np.inf)


def median(rows: Rows, s: Step) -> tuple[np.ndarray, np.ndarray]:
    """Median of the values in a short window: nulls sort behind them."""
    x, known = rows.get(s.x)
    (n,) = rows.over(("count", s.x), lambda: (known.astype(float),), added, (0.0,), s.window)
    padded = np.concatenate([np.full(s.window - 1, np.nan), np.where(known, x, np.nan)])
    frames = np.lib.stride_tricks.sliding_window_view(padded, s.window).copy()
    early = rows.place < s.window - 1
    ago = np.arange(s.window - 1, -1, -1)
    frames[early] = np.where(rows.place[early][:, None] < ago, np.nan, frames[early])
    frames.sort(axis=1)
    at, line = np.maximum(n - 1, 0) / 2, np.arange(len(x))
    low, high = frames[line, np.floor(at).astype(int)], frames[line, np.ceil(at).astype(int)]
    return np.where(low == high, low, (low + high) / 2), (n >= s.need) & (n > 0)


def earlier(rows: Rows, s: Step) -> tuple[np.ndarray, np.ndarray]:
    x, known = rows.get(s.x)
    return rows.back(x, s.window, 0.0), rows.back(known, s.window, False)


def positive(rows: Rows, s: Step) -> tuple[np.ndarray, np.ndarray]:
    x, known = rows.get(s.x)
    return (~(x <= 0)).astype(float), known  # not-a-number is the greatest value


OTHERS = {"max": extreme, "min": extreme, "drawdown": drawdown, "median": median, "lag": earlier, "positive": positive}


def walk(by: list[str], order: str, steps: tuple[Step, ...], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a part: takes its batches in order and gives back ``names`` of them and of the steps, cut between entities."""

    def starts_of(table: pa.Table) -> np.ndarray:
        """First rows of the entities; rows out of order are an error, never a wrong value."""
        changed = np.zeros(table.num_rows, dtype=bool)
        changed[0] = True
        for key in by:
            codes = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            changed[1:] |= codes[1:] != codes[:-1]
        dates = table.column(order).combine_chunks()
        falls = pc.less(dates.slice(1), dates.slice(0, len(dates) - 1)).fill_null(False).to_numpy(zero_copy_only=False)
        if (falls & ~changed[1:]).any():
            raise ValueError(f"rows of {by} are not in order of {order}")
        return np.flatnonzero(changed)

    def computed(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = Rows(table, starts)
        with np.errstate(all="ignore"):
            for s in steps:
                value, there = OTHERS.get(s.kind, statistic)(rows, s)
                rows.added[s.name] = value, there
                table = table.append_column(s.name, pa.array(value, mask=~there, type=pa.float64()))
        yield from table.select(names).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([*held, batch])
            starts = starts_of(table)
            last = int(starts[-1])
            if last:
                yield from computed(table.slice(0, last), starts[:-1])
            held = table.slice(last).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from computed(table, starts_of(table))

    return run
