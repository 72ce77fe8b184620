"""As-of joins: the latest value knowable at each row's date.

Both sides are interleaved on one timeline and the last right-hand struct is carried forward: one shuffle however many columns
are attached, no range join. A struct is carried, so a matched row whose value is null stays null instead of falling back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampType

from panelstone.session import stacked


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_on: str,
    right_on: str,
    values: dict[str, str],
    order_ties: list[str] | None = None,
    bucket: Column | None = None,
    strict: bool = False,
) -> DataFrame:
    """Attach ``values`` (right column -> output name) of the last right row at or before ``left_on``.

    ``order_ties`` orders right rows that share a timestamp. ``bucket`` is an expression over ``_at`` that splits each entity's
    timeline; give it whenever one entity may hold a large share of the rows. Carry-over between buckets comes from one
    map-side-combined aggregate, so the split changes nothing in the result. ``strict`` excludes equal timestamps. Without ``by`` a
    timeline of dates or times is split by calendar month.
    """
    if not by and bucket is None and isinstance(left.schema[left_on].dataType, DateType | TimestampType):
        bucket = F.date_trunc("month", "_at")
    ties = order_ties or []
    payload = F.struct(*[F.col(src).alias(dst) for src, dst in values.items()])
    left_cols = left.columns
    l = left.select(
        *by,
        F.col(left_on).alias("_at"),
        F.lit(0 if strict else 1).alias("_side"),
        F.struct(*left_cols).alias("_row"),
        *[F.lit(None).cast(right.schema[t].dataType).alias(f"_tie_{t}") for t in ties],
    )
    r = right.where(F.col(right_on).isNotNull()).select(
        *by,
        F.col(right_on).alias("_at"),
        F.lit(1 if strict else 0).alias("_side"),
        *[F.col(t).alias(f"_tie_{t}") for t in ties],
        payload.alias("_hit"),
    )
    keys = list(by)
    if bucket is not None:
        l, r = l.withColumn("_bk", bucket), r.withColumn("_bk", bucket)
        keys = [*by, "_bk"]
    both = l.transform(stacked, r, allowMissingColumns=True)
    order = ["_at", "_side", *[f"_tie_{t}" for t in ties]]
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order)
    else:
        w = Window.orderBy(*order)
    hit = F.last("_hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_last", hit).where(F.col("_row").isNotNull())
    if bucket is not None:
        both = both.join(_carry(l, r, by, order), keys, "left").withColumn("_last", F.coalesce("_last", "_carry"))
    return both.select(
        *[F.col(f"_row.{x}").alias(x) for x in left_cols], *[F.col(f"_last.{dst}").alias(dst) for dst in values.values()]
    )


def _carry(l: DataFrame, r: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """For every (entity, bucket) present on the left: the last right struct of any earlier bucket."""
    ends = r.groupBy(*by, "_bk").agg(F.max_by("_hit", F.struct(*order)).alias("_end"))
    if not by:
        # One row with an entry per bucket that holds anything: bounded by the calendar.
        known = ends.agg(F.sort_array(F.collect_list(F.struct("_bk", "_end"))).alias("_ends"))
        earlier = F.filter("_ends", lambda x: x["_bk"] < F.col("_bk"))
        cells = l.select("_bk").distinct().join(F.broadcast(known))
        return cells.select("_bk", F.try_element_at(earlier, F.lit(-1))["_end"].alias("_carry"))
    cells = l.select(*by, "_bk").distinct().withColumn("_ask", F.lit(True))
    cells = cells.join(ends, [*by, "_bk"], "full_outer")
    w = Window.partitionBy(*by).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    return (
        cells.withColumn("_carry", F.last("_end", ignorenulls=True).over(w)).where(F.col("_ask")).select(*by, "_bk", "_carry")
    )


def lag_asof(df: DataFrame, by: list[str], date: str, columns: list[str], lags: dict[str, int]) -> DataFrame:
    """Values as they stood ``days`` calendar days earlier: ``lags`` maps an output suffix to days.

    All lags share one interleaved timeline: each shifted copy of the frame carries its own struct, and one ordered pass
    carries every struct forward.
    """
    src = df.columns
    base = df.select(*by, F.col(date).alias("_at"), F.lit(1).alias("_side"), F.struct(*src).alias("_row"))
    both = base
    for suffix, days in lags.items():
        shifted = df.select(
            *by,
            F.date_add(date, days).alias("_at"),
            F.lit(0).alias("_side"),
            F.struct(*[F.col(x).alias(f"{x}{suffix}") for x in columns]).alias(f"_hit{suffix}"),
        )
        both = both.transform(stacked, shifted, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({f"_last{s}": F.last(f"_hit{s}", ignorenulls=True).over(w) for s in lags})
    return both.where(F.col("_row").isNotNull()).select(
        *[F.col(f"_row.{x}").alias(x) for x in src],
        *[F.col(f"_last{s}.{x}{s}").alias(f"{x}{s}") for s in lags for x in columns],
    )


def attach_wide(
    grid: DataFrame,
    facts: DataFrame,
    concepts: list[str],
    by: str = "company_id",
    date: str = "date",
    available: str = "available_at",
    concept: str = "concept",
    value: str = "value",
    with_dates: bool = True,
) -> DataFrame:
    """Latest knowable value of every concept plus the date it became available, in one shuffle.

    The long facts become one wide row per availability date, interleave with the grid, and every concept is carried forward
    as a (value, date) struct.
    """
    wide = (
        facts.where(F.col(concept).isin(concepts))
        .groupBy(by, F.col(available).alias("_at"))
        .agg(
            *[
                F.max(F.when(F.col(concept) == x, F.struct(F.col(value).alias("v"), F.col(available).alias("d")))).alias(f"_f_{x}")
                for x in concepts
            ]
        )
        .withColumn("_side", F.lit(0))
    )
    rows = grid.select(by, F.col(date).alias("_at"), F.lit(1).alias("_side"), F.struct(*grid.columns).alias("_row"))
    w = Window.partitionBy(by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.transform(stacked, wide, allowMissingColumns=True).withColumns(
        {f"_f_{x}": F.last(f"_f_{x}", ignorenulls=True).over(w) for x in concepts}
    )
    out = [F.col(f"_row.{x}").alias(x) for x in grid.columns]
    for x in concepts:
        out.append(F.col(f"_f_{x}.v").alias(x))
        if with_dates:
            out.append(F.col(f"_f_{x}.d").alias(f"{x}__asof"))
    return both.where(F.col("_row").isNotNull()).select(*out)


def filled_wide(facts: DataFrame, concepts: list[str], by: str, available: str, concept: str = "concept", value: str = "value") -> DataFrame:
    """One row per (entity, filing date) with every concept forward-filled from earlier filings."""
    wide = facts.groupBy(by, available).agg(*[F.max(F.when(F.col(concept) == x, F.col(value))).alias(x) for x in concepts])
    w = Window.partitionBy(by).orderBy(available).rowsBetween(Window.unboundedPreceding, 0)
    return wide.withColumns({x: F.last(x, ignorenulls=True).over(w) for x in concepts})


def horizon_returns(
    decisions: DataFrame, prices: DataFrame, dates: DataFrame, months: list[int], benchmark: str, sessions_per_month: int = 21
) -> DataFrame:
    """Return from each decision date to ``21 x months`` sessions later, and its excess over the benchmark.

    Horizons count sessions of the calendar; a security not priced at either end has no return.
    """
    from panelstone.operators.calendar import session_index

    idx = F.broadcast(session_index(dates))  # one row per session
    px = prices.select("ticker", "date", "close_adj")
    out = decisions.join(idx, "date").join(
        px.withColumnRenamed("close_adj", "_p0"), ["ticker", "date"], "left"
    )
    bench = px.where(F.col("ticker") == benchmark).join(idx, "date").select("idx", F.col("close_adj").alias("_b"))
    bench = F.broadcast(bench)  # one row per session
    out = out.join(bench.select("idx", F.col("_b").alias("_b0")), "idx", "left")
    priced = px.join(idx, "date").select("ticker", F.col("idx").alias("_end"), F.col("close_adj").alias("_p1"))
    for m in months:
        step = sessions_per_month * m
        out = (
            out.withColumn("_end", F.col("idx") + step)
            .join(priced, ["ticker", "_end"], "left")
            .join(bench.select(F.col("idx").alias("_end"), F.col("_b").alias("_b1")), "_end", "left")
            .withColumn(f"fwd_{m}m", F.try_divide("_p1", "_p0") - 1.0)
            .withColumn(f"excess_{m}m", F.col(f"fwd_{m}m") - (F.try_divide("_b1", "_b0") - 1.0))
            .drop("_p1", "_b1", "_end")
        )
    return out.drop("idx", "_p0", "_b0")
