"""Analyst estimates and earnings events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstone.functions.numeric import TINY, clip

MIN_ANALYSTS = 3


def normalise_estimates(wide: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    """One row per key and metric from ``<metric>_<field>`` columns."""
    fields = ("consensus", "low", "high", "growth", "n_analysts")
    cells = [
        F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}_{f}").cast("double").alias(f) for f in fields if f"{m}_{f}" in wide.columns])
        for m in metrics
    ]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("_e")).select(*keys, "_e.*")


def normalise_events(events: DataFrame) -> DataFrame:
    """Surprise as a fraction of the estimate, limited to +-10; an event without an actual lies ahead."""
    gap = F.when(F.abs("estimate") > TINY, (F.col("actual") - F.col("estimate")) / F.abs("estimate"))
    return events.withColumns({"surprise": clip(gap, -10.0, 10.0), "is_future": F.col("actual").isNull()})


def latest_snapshot(estimates: DataFrame) -> DataFrame:
    newest = estimates.agg(F.max("as_of").alias("as_of"))
    return estimates.join(F.broadcast(newest), "as_of")


def revision_balance(estimates: DataFrame, period: str = "+1y") -> DataFrame:
    """(up - down) / (up + down); null when nobody revised."""
    up, down = F.coalesce("up_30d", F.lit(0)), F.coalesce("down_30d", F.lit(0))
    picked = latest_snapshot(estimates).where((F.col("metric") == "eps") & (F.col("period") == period))
    return picked.select("company_id", F.when(up + down > 0, (up - down) / (up + down)).cast("double").alias("eps_revision_3m"))


def consensus_drift(estimates: DataFrame, metric: str = "revenue", period: str = "+1y", lookback_days: int = 90, name: str = "revenue_revision_3m") -> DataFrame:
    """Change of the consensus against the last snapshot at least ``lookback_days`` older than the newest one."""
    own = estimates.where((F.col("metric") == metric) & (F.col("period") == period)).select("company_id", "as_of", "consensus")
    newest = own.agg(F.max("as_of").alias("_newest"))
    tagged = own.join(F.broadcast(newest))
    old = F.col("as_of") <= F.date_sub("_newest", lookback_days)
    both = tagged.groupBy("company_id").agg(
        F.max_by(F.when(old, F.struct("consensus")), F.when(old, F.col("as_of"))).alias("_prior"),
        F.max(F.when(F.col("as_of") == F.col("_newest"), F.struct("consensus"))).alias("_now"),
    )
    prior, now = F.col("_prior.consensus"), F.col("_now.consensus")
    return both.where(F.col("_prior").isNotNull() & F.col("_now").isNotNull()).select(
        "company_id", F.when(F.abs(prior) > TINY, (now - prior) / F.abs(prior)).alias(name)
    )


def _by_period(estimates: DataFrame, metric: str) -> DataFrame:
    """This and next fiscal year side by side: a full outer match done as one conditional aggregate."""
    sub = latest_snapshot(estimates).where((F.col("metric") == metric) & F.col("period").isin("0y", "+1y"))
    cell = lambda p, f: F.max(F.when(F.col("period") == p, F.col(f)))
    return sub.groupBy("company_id").agg(
        cell("0y", "consensus").alias("this_year"),
        cell("+1y", "consensus").alias("next_year"),
        cell("+1y", "low").alias("next_low"),
        cell("+1y", "high").alias("next_high"),
        cell("+1y", "growth").alias("growth"),
        cell("+1y", "n_analysts").cast("int").alias("n"),
        F.max(F.col("period") == "+1y").alias("has_next"),
    )


def consensus_revenue(estimates: DataFrame, min_analysts: int = MIN_ANALYSTS) -> DataFrame:
    both = _by_period(estimates, "revenue")
    thick = F.coalesce("n", F.lit(0)) >= min_analysts
    keep = {"this_year": "this_year", "next_year": "next_year", "next_low": "next_low", "next_high": "next_high"}
    return both.select(
        "company_id",
        *[F.when(thick, F.col(src)).alias(f"consensus_revenue_{dst}") for src, dst in keep.items()],
        F.col("n").alias("n_revenue_analysts"),
    )


def forward_growth(estimates: DataFrame, min_analysts: int = MIN_ANALYSTS) -> DataFrame:
    both = _by_period(estimates, "eps").where("has_next")
    implied = F.when(F.abs("this_year") > TINY, F.col("next_year") / F.col("this_year") - 1.0)
    thick = F.coalesce("n", F.lit(0)) >= min_analysts
    return both.select(
        "company_id",
        F.when(thick, F.coalesce("growth", implied)).alias("forward_eps_growth"),
        F.when(thick, F.col("next_year")).alias("forward_eps"),
        F.col("this_year").alias("consensus_eps_this_year"),
        F.col("n").alias("n_analysts"),
    )


def earnings_surprise(events: DataFrame, as_of: Column, quarters: int = 4) -> DataFrame:
    """Mean surprise and hit rate over the last reported events (one row per company and event date)."""
    reported = events.where(~F.col("is_future") & F.col("surprise").isNotNull() & (F.col("event_date") <= as_of))
    recent = F.row_number().over(Window.partitionBy("company_id").orderBy(F.col("event_date").desc()))
    return (
        reported.withColumn("_r", recent)
        .where(F.col("_r") <= quarters)
        .groupBy("company_id")
        .agg(F.avg("surprise").alias("earnings_surprise"), F.avg((F.col("surprise") > 0).cast("double")).alias("surprise_hit_rate"))
    )


def next_earnings(events: DataFrame, as_of: Column) -> DataFrame:
    ahead = events.where(F.col("event_date") > as_of).groupBy("company_id").agg(F.min("event_date").alias("next_earnings_date"))
    return ahead.withColumn("days_to_earnings", F.datediff("next_earnings_date", as_of))


def post_earnings_drift(events: DataFrame, prices: DataFrame, securities: DataFrame, as_of: Column, benchmark: str, window: int = 3) -> DataFrame:
    """Benchmark-relative return from the last bar at or before the latest event to at most ``window`` bars later."""
    last = events.where(~F.col("is_future") & (F.col("event_date") <= as_of)).groupBy("company_id").agg(
        F.max("event_date").alias("last_earnings_date")
    )
    market = prices.where(F.col("ticker") == benchmark).select("date", F.col("close_adj").alias("_m"))
    px = (
        prices.join(securities.where("is_primary").select("company_id", "ticker"), "ticker")
        .join(last, "company_id")
        .join(F.broadcast(market), "date", "left")  # one row per session
    )
    after = F.col("date") > F.col("last_earnings_date")
    step = F.sum(after.cast("int")).over(Window.partitionBy("company_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    bar = F.struct(F.col("close_adj").alias("p"), F.col("_m").alias("m"))
    ends = (
        px.withColumn("_step", step)
        .where(F.col("_step") <= window)
        .groupBy("company_id", "last_earnings_date")
        .agg(
            F.max_by(F.when(~after, bar), F.when(~after, F.col("date"))).alias("a"),
            F.max_by(F.when(after, bar), F.when(after, F.col("date"))).alias("b"),
        )
    )
    drift = F.try_divide("b.p", "a.p") - F.try_divide("b.m", "a.m")
    return ends.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(
        "company_id", drift.alias("post_earnings_drift"), "last_earnings_date"
    )


def build_estimate_metrics(estimates: DataFrame, events: DataFrame, prices: DataFrame, securities: DataFrame, as_of: Column, benchmark: str) -> DataFrame:
    """All estimate-derived metrics, one row per company."""
    companies = securities.where("is_primary").select("company_id").distinct()
    pieces = [
        revision_balance(estimates),
        consensus_drift(estimates),
        forward_growth(estimates),
        consensus_revenue(estimates),
        earnings_surprise(events, as_of),
        next_earnings(events, as_of),
        post_earnings_drift(events, prices, securities, as_of, benchmark),
    ]
    return reduce(lambda out, piece: out.join(piece, "company_id", "left"), pieces, companies)
