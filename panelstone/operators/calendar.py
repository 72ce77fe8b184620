"""Session calendars, date grids and date shifts. A calendar has one row per session, so its windows stay small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(prices: DataFrame, benchmark: str | None = None) -> DataFrame:
    """Distinct trading dates: the benchmark's own when it has any, otherwise every date seen."""
    dates = prices.select("date").distinct()
    if benchmark is None:
        return dates
    # One scan: dates on which the benchmark traded, and whether it traded at all.
    flagged = prices.groupBy("date").agg(F.max(F.col("ticker") == benchmark).alias("_own"))
    seen = flagged.agg(F.coalesce(F.max("_own"), F.lit(False)).alias("any_own"))
    return flagged.join(F.broadcast(seen), flagged["_own"] | ~F.col("any_own")).select("date")


def session_index(dates: DataFrame) -> DataFrame:
    """``date, idx`` with idx counting sessions from zero (one row per session: bounded by the calendar)."""
    return dates.select("date", (F.row_number().over(Window.orderBy("date")) - 1).cast("int").alias("idx"))


def next_weekday(d: Column) -> Column:
    """The weekday after ``d`` (Friday and the weekend go to Monday)."""
    dow = F.dayofweek(d)  # 1 = Sunday
    return F.date_add(d, F.when(dow == 6, 3).when(dow == 7, 2).otherwise(1))


def next_session(df: DataFrame, dates: DataFrame, on: str, name: str = "next_session") -> DataFrame:
    """First session strictly after ``on``; past the end of the calendar, the next weekday.

    Every calendar day maps to its next session through a day-by-day calendar table, so the lookup is an equi-join.
    """
    ordered = Window.orderBy("date")
    gaps = dates.select("date", F.lead("date").over(ordered).alias("_next"))
    days = gaps.where(F.col("_next").isNotNull()).select(
        F.explode(F.sequence("date", F.date_sub("_next", 1))).alias("_day"), F.col("_next").alias("_session")
    )
    first = dates.agg(F.min("date").alias("_first"))
    out = df.join(days, F.col(on) == F.col("_day"), "left").join(F.broadcast(first))
    chosen = F.when(F.col(on) < F.col("_first"), F.col("_first")).otherwise(
        F.coalesce(F.col("_session"), next_weekday(F.col(on)))
    )
    return out.withColumn(name, F.when(F.col(on).isNotNull(), chosen)).select(*df.columns, name)


def week_and_recent_grid(dates: DataFrame, years: int, recent_days: int) -> DataFrame:
    """Last session of every ISO week over ``years`` plus every session of the last ``recent_days`` days."""
    last = dates.agg(F.max("date").alias("_end"))
    d = dates.join(F.broadcast(last))
    week = Window.partitionBy(F.extract(F.lit("YEAROFWEEK"), "date"), F.weekofyear("date"))
    span = F.col("date") >= F.date_sub("_end", 365 * years)
    kept = d.where(span).withColumn("_last", F.max("date").over(week))
    return kept.where((F.col("date") == F.col("_last")) | (F.col("date") >= F.date_sub("_end", recent_days))).select("date")


def month_end_sessions(dates: DataFrame, start=None, end=None) -> DataFrame:
    """Last session of each calendar month inside the range."""
    d = dates
    if start is not None:
        d = d.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        d = d.where(F.col("date") <= F.lit(end).cast("date"))
    return d.groupBy(F.trunc("date", "MM").alias("_m")).agg(F.max("date").alias("date")).select("date")


def month_ends(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Last calendar day of each month that falls inside [start, end] of a one-row frame."""
    months = F.explode(F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month")))
    each = bounds.select(start, end, months.alias("_m")).select(start, end, F.last_day("_m").alias("date"))
    return each.where(F.col("date").between(F.col(start), F.col(end))).select("date")


def shift_dates(decisions: DataFrame, dates: DataFrame, offset: int) -> DataFrame:
    """Move each decision date by a number of sessions; those leaving the calendar are dropped."""
    idx = session_index(dates)
    src = idx.join(decisions.select("date").distinct(), "date").select((F.col("idx") + offset).alias("idx"))
    return src.join(idx, "idx").select("date").distinct()


def latest_session(dates: DataFrame, today: Column, before_open: Column) -> DataFrame:
    """Most recent session on or before today, or before today when the market has not opened."""
    limit = F.when(before_open, F.date_sub(today, 1)).otherwise(today)
    return dates.where(F.col("date") <= limit).agg(F.max("date").alias("date"))
