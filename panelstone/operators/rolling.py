"""Rolling statistics over an entity's own rows.

Sums, means, deviations, regressions and extremes come from short sliding frames, looked up at equal distances and merged to long ones:
a window of w rows costs some 3 * sqrt(w) additions and sqrt(w) / 3 lookups a row, and all frames share one sort of narrow rows.
(Block-wise running states are linear but take two sorts of widened rows for each length.) Drawdowns still run over blocks. An entity
holds at most one row per session, so its frames are bounded by the calendar (a century of daily sessions is about 25,000 rows).

Rows that are ``Ordered`` are worked on as arrays instead, by one pass for all that waits (``passes``), with the same results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstone.functions.numeric import VAR_FLOOR, div, finite
from panelstone.operators.passes import Ordered, Step


#: Windows up to this length are summed directly.
DIRECT = 64


def along(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def shift(x: Column | str, n: int, by: list[str], order: str) -> Column:
    return F.lag(x, n).over(along(by, order))


@dataclass(frozen=True)
class Roll:
    """One rolling statistic.

    ``kind``: sum, mean, std (sample), var_pop, rms, beta (x on y, population moments), corr_alpha.
    ``min_n``: non-null observations required (default: the full window). ``full``: also require ``window`` rows.
    """

    name: str
    kind: str
    x: Column | str
    window: int
    min_n: int | None = None
    y: Column | str | None = None
    full: bool = False
    scale: float = 1.0


def piece(window: int) -> int:
    """Length of the equal pieces that make up a long window: a divisor near three roots of it, or the window itself."""
    parts = [p for p in range(2, window) if window % p == 0] if window > DIRECT else []
    return min(parts, key=lambda p: abs(p - 3 * window**0.5), default=window)


def tiled(window: int, name: str, by: list[str], order: str) -> tuple[list[str], dict[str, Column]]:
    """The names of a piece's state at a row and one, two, ... pieces before it, and the columns to add for them."""
    back = {f"{name}_{k}": F.lag(name, k).over(along(by, order)) for k in range(piece(window), window, piece(window))}
    return [name, *back], back


def waiting(df: Ordered, by: list[str], order: str) -> Ordered:
    """``df`` itself, if its rows lie as the caller means."""
    if df.by != by or df.order != order:
        raise ValueError(f"rows are in order of {df.by} and {df.order}, not of {by} and {order}")
    return df


def _rolling_in_order(df: Ordered, specs: list[Roll]) -> Ordered:
    names: dict[str, str] = {}
    for x in [x for s in specs for x in (s.x, s.y) if x is not None]:
        if isinstance(x, str):
            names[x] = x
        elif str(x) not in names:
            df, names[str(x)] = df.with_input(x.cast("double"))
    need = lambda s: s.window if s.min_n is None else s.min_n
    y = lambda s: None if s.y is None else names[str(s.y)]
    return df.after(*[Step(s.name, s.kind, names[str(s.x)], s.window, need(s), y(s), s.full, s.scale) for s in specs])


def rolling(df: DataFrame | Ordered, by: list[str], order: str, specs: list[Roll]) -> DataFrame | Ordered:
    """Add every statistic in ``specs``.

    A short window is summed afresh over its own rows. A long one is laid out in equal pieces, whose sums and central moments are looked up
    and merged. Either way a value rests on its own rows only, whatever came before, and no digits cancel. All lengths are frames of
    one ordering: rows sorted once by entity and date serve this call and the next ones.
    """
    if isinstance(df, Ordered):
        return _rolling_in_order(waiting(df, by, order), specs)
    inputs: dict[str, Column] = {}
    names: dict[str, str] = {}

    def column(x: Column | str) -> Column:
        key = str(x)
        if key not in names:
            names[key] = f"_x{len(names)}"
            inputs[names[key]] = finite(x)
        return F.col(names[key])

    slots: dict[tuple, tuple[str, list[str]]] = {}
    states: dict[str, Column] = {}
    earlier: dict[str, Column] = {}

    def slot(window: int, what: str, aggregate: Callable) -> list[str]:
        key = (window, what)
        if key not in slots:
            name = f"_s{len(slots)}"
            frame = along(by, order).rowsBetween(-(piece(window) - 1), Window.currentRow)
            states[name] = F.coalesce(aggregate(frame).cast("double"), F.lit(0.0))
            slots[key], back = tiled(window, name, by, order)
            earlier.update({k: F.coalesce(c, F.lit(0.0)) for k, c in back.items()})
        return slots[key]

    def moments(s: Roll) -> dict[str, list[str]]:
        """Slots of the count, the sum and the central moments that a statistic needs."""
        x, y = column(s.x), column(s.y) if s.y is not None else None
        tag = f"{x}, {y}"
        if y is not None:
            both = x.isNotNull() & y.isNotNull()
            x, y = F.when(both, x), F.when(both, y)
        out = {"n": lambda w: F.count(x).over(w), "x": lambda w: F.sum(x).over(w)}
        if y is not None:
            out["y"] = lambda w: F.sum(y).over(w)
            out["xy"] = lambda w: F.covar_pop(x, y).over(w) * F.count(x).over(w)
            out["yy"] = lambda w: F.var_pop(y).over(w) * F.count(x).over(w)
        elif s.kind in ("std", "var_pop"):
            out["xx"] = lambda w: F.var_pop(x).over(w) * F.count(x).over(w)
        return {k: slot(s.window, f"{k} of {tag}", f) for k, f in out.items()}

    plan = [(s, moments(s)) for s in specs]
    work = df.withColumns(inputs).withColumns({"_row": F.row_number().over(along(by, order)), **states})
    if earlier:
        work = work.withColumns(earlier)
    total = lambda parts: reduce(add, [F.col(x) for x in parts])
    counts = {f"{parts['n'][0]}n": total(parts["n"]) for _, parts in plan}
    means = {f"{parts[k][0]}m": div(total(parts[k]), f"{parts['n'][0]}n") for _, parts in plan for k in ("x", "y") if k in parts}
    work = work.withColumns(counts).withColumns(means)

    outputs = {}
    for s, parts in plan:
        n = F.col(f"{parts['n'][0]}n")
        mean = lambda k: F.col(f"{parts[k][0]}m")  # noqa: B023, E731

        def merged(k, left, right):
            """Moments within the pieces and of the pieces' means about the common one."""
            if len(parts[k]) == 1:  # noqa: B023
                return total(parts[k])  # noqa: B023
            apart = lambda q, i: div(parts[q][i], parts["n"][i]) - mean(q)  # noqa: B023, E731
            between = [F.coalesce(F.col(c) * apart(left, i) * apart(right, i), F.lit(0.0)) for i, c in enumerate(parts["n"])]  # noqa: B023
            return total(parts[k]) + reduce(add, between)  # noqa: B023

        need = s.window if s.min_n is None else s.min_n
        gate = n >= need
        if s.full:
            gate = gate & (F.col("_row") >= s.window)
        if s.kind == "sum":
            value = total(parts["x"])
        elif s.kind == "mean":
            value = mean("x")
        elif s.kind == "rms":
            value = F.sqrt(F.greatest(mean("x"), F.lit(0.0)))
        elif s.kind == "std":
            gate = gate & (n >= 2)
            value = F.sqrt(div(merged("xx", "x", "x"), n - 1))
        elif s.kind == "var_pop":
            value = div(merged("xx", "x", "x"), n)
        elif s.kind == "beta":
            yy = merged("yy", "y", "y")
            gate = gate & (div(yy, n) > VAR_FLOOR)
            value = div(merged("xy", "x", "y"), yy)
        else:
            raise ValueError(f"unknown rolling kind {s.kind!r}")
        outputs[s.name] = F.when(gate, value * s.scale) if s.scale != 1.0 else F.when(gate, value)
    return work.withColumns(outputs).drop(*inputs, *states, *earlier, *counts, *means, "_row")


def rolling_extreme(df: DataFrame | Ordered, by: list[str], order: str, x: str, window: int, name: str, low: bool = False) -> DataFrame | Ordered:
    """Rolling maximum (or minimum) over a full window of non-null values, from those of the window's pieces."""
    if isinstance(df, Ordered):
        return waiting(df, by, order).after(Step(name, "min" if low else "max", x, window))
    pick, join = (F.min, F.least) if low else (F.max, F.greatest)
    frame = along(by, order).rowsBetween(-(piece(window) - 1), Window.currentRow)
    work = df.withColumns({"_best": pick(x).over(frame), "_seen": F.count(x).over(frame)})
    (best, more), (seen, others) = tiled(window, "_best", by, order), tiled(window, "_seen", by, order)
    work = work.withColumns(more | others)
    full = reduce(add, [F.coalesce(F.col(c), F.lit(0)) for c in seen]) == window
    value = join(*best) if len(best) > 1 else F.col("_best")
    return work.withColumn(name, F.when(full, value)).drop(*best, *seen)


def rolling_drawdown(df: DataFrame | Ordered, by: list[str], order: str, x: str, window: int, name: str) -> DataFrame | Ordered:
    """Worst peak-to-trough decline with peak and trough inside the same trailing window.

    A window is a block tail followed by a block head; its worst decline lies in the tail, in the head, or runs from the
    tail's peak to the head's trough. All three come from running states, so no window is ever collected. The tails are sorted
    backwards; what looks back over blocks is ordered by block and row, the sorting that the heads need anyway.
    """
    if isinstance(df, Ordered):
        return waiting(df, by, order).after(Step(name, "drawdown", x, window))
    cell = [*by, "_block"]
    head = Window.partitionBy(*cell).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    tail = Window.partitionBy(*cell).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    at = Window.partitionBy(*by).orderBy("_block", order)
    work = df.withColumn("_row", F.row_number().over(along(by, order))).withColumns(
        {"_block": F.floor((F.col("_row") - 1) / window), "_p": F.when(F.col(x) > 0, F.col(x))}
    )
    work = work.withColumns(
        {"_tail_max": F.max("_p").over(tail), "_tail_min": F.min("_p").over(tail)}
    ).withColumn("_tail_dd", F.min(div("_tail_min", "_p")).over(tail))
    work = work.withColumns(
        {"_from_max": F.lag("_tail_max", window - 1).over(at), "_from_dd": F.lag("_tail_dd", window - 1).over(at)}
    )
    work = work.withColumns(
        {"_head_max": F.max("_p").over(head), "_head_min": F.min("_p").over(head)}
    ).withColumn("_head_dd", F.min(div("_p", "_head_max")).over(head))
    aligned = F.col("_row") % window == 0
    worst = F.when(aligned, F.col("_head_dd")).otherwise(
        F.least("_from_dd", "_head_dd", div("_head_min", "_from_max"))
    )
    return work.withColumn(name, F.when(F.col("_row") >= window, worst - 1.0)).drop(
        "_row", "_block", "_p", "_head_max", "_head_min", "_head_dd", "_tail_max", "_tail_min", "_tail_dd", "_from_max", "_from_dd"
    )


def rolling_median(x: Column | str, by: list[str], order: str, window: int, min_n: int) -> Column:
    """Median of the non-null values of the last ``window`` rows (a short frame: the one order statistic kept sliding)."""
    x = F.col(x) if isinstance(x, str) else x
    frame = along(by, order).rowsBetween(-(window - 1), 0)
    return F.when(F.count(x).over(frame) >= min_n, F.percentile(x, F.lit(0.5)).over(frame))


def add_rolling_median(df: DataFrame | Ordered, x: str, by: list[str], order: str, window: int, min_n: int, name: str) -> DataFrame | Ordered:
    if isinstance(df, Ordered):
        return waiting(df, by, order).after(Step(name, "median", x, window, min_n))
    return df.withColumn(name, rolling_median(x, by, order, window, min_n))


def add_shift(df: DataFrame | Ordered, x: str, n: int, by: list[str], order: str, name: str) -> DataFrame | Ordered:
    if isinstance(df, Ordered):
        return waiting(df, by, order).after(Step(name, "lag", x, n))
    return df.withColumn(name, shift(x, n, by, order))


def add_positive(df: DataFrame | Ordered, x: str, name: str) -> DataFrame | Ordered:
    """One where ``x`` is above zero, zero where it is not."""
    if isinstance(df, Ordered):
        return df.after(Step(name, "positive", x, 1))
    return df.withColumn(name, (F.col(x) > 0).cast("double"))


def day_range(by: list[str], date: str, days: int):
    """Half-open time frame (t - days, t] over calendar days."""
    return Window.partitionBy(*by).orderBy(F.unix_date(F.col(date))).rangeBetween(-(days - 1), 0)


def day_rolling(x: Column | str, stat: str, by: list[str], date: str, days: int, min_n: int) -> Column:
    """Sample deviation, mean or median over a trailing span of calendar days."""
    x = F.col(x) if isinstance(x, str) else x
    frame = day_range(by, date, days)
    agg = {"std": F.stddev_samp(x), "mean": F.avg(x), "median": F.percentile(x, F.lit(0.5))}[stat]
    return F.when(F.count(x).over(frame) >= min_n, agg.over(frame))


def max_drawdown_running(df: DataFrame, by: list[str], order: str, x: str, name: str) -> DataFrame:
    """Decline from the running peak at every row."""
    w = along(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, div(x, F.max(x).over(w)) - 1.0)


def compound(df: DataFrame, by: list[str], order: str, ret: str, name: str) -> DataFrame:
    """Growth of one unit along a return series; a null return leaves the level unchanged."""
    w = along(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.product(1.0 + F.coalesce(F.col(ret), F.lit(0.0))).over(w))


def forward_fill(x: str, by: list[str], order: str) -> Column:
    w = along(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(x, ignorenulls=True).over(w)
