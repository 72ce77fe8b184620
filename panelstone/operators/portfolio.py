"""Target weights from a ranking, and the period returns, turnover and costs of holding them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstone.operators.calendar import session_index, sessions
from panelstone.operators.holdings import outcomes, run_periods, schedule
from panelstone.operators.ranking import add_ordinal_rank
from panelstone.session import cut_lineage, stacked

ONE_WAY_BPS = 1.5 + 2.5 + 0.5  # fixed values: commission, half spread, slippage


def size_for(n: Column, fraction: float | None = None, top_n: int | None = None) -> Column:
    """Number of names to hold: a fixed count or a fraction of the universe, halves rounding to even."""
    if fraction is None:
        return F.lit(top_n)
    return F.greatest(F.bround(n * F.lit(float(fraction)), 0).cast("int"), F.lit(1))


def select_names(
    ranked: DataFrame, top_n: int, max_sector_weight: float | None = None, score: str = "score", entity: str = "security_id"
) -> DataFrame:
    """Best ``top_n`` names of each date, ties by entity, with at most ``top_n x cap`` names per sector.

    A rank limit is applied before the shuffle, so a date only ever moves its best names.
    """
    best = (F.col(score).desc(), F.col(entity).asc())
    kept = ranked.where(F.col(score).isNotNull())
    if max_sector_weight is not None:
        per_sector = max(1, int(top_n * max_sector_weight))
        in_sector = F.row_number().over(Window.partitionBy("date", "sector").orderBy(*best))
        kept = kept.withColumn("_s", in_sector).where(F.col("_s") <= per_sector).drop("_s")
    position = F.row_number().over(Window.partitionBy("date").orderBy(*best))
    return kept.withColumn("position", position).where(F.col("position") <= top_n)


def select_fraction(ranked: DataFrame, fraction: float, score: str = "score", entity: str = "security_id") -> DataFrame:
    """Best fraction of each date's names. The cut grows with the universe, so ranks come from the split ranking."""
    counts = ranked.where(F.col(score).isNotNull()).groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    out = add_ordinal_rank(ranked.where(F.col(score).isNotNull()), ["date"], score, entity, "position", descending=True)
    return out.join(counts, "date").where(F.col("position") <= size_for(F.col("_n"), fraction)).drop("_n")


def add_weights(chosen: DataFrame, weighting: str = "equal", max_position_weight: float | None = None, score: str = "score") -> DataFrame:
    """Equal weights, or weights proportional to the score above the selection's floor; what a cap cuts stays in cash."""
    agg = chosen.groupBy("date").agg(F.count(F.lit(1)).alias("_k"), F.min(score).alias("_floor"), F.sum(score).alias("_sum"))
    out = chosen.join(agg, "date")
    room = F.col("_sum") - F.col("_k") * F.col("_floor")
    equal = 1.0 / F.col("_k")
    raw = F.when(room > 1e-12, (F.col(score) - F.col("_floor")) / room).otherwise(equal) if weighting == "score_proportional" else equal
    if max_position_weight is not None:
        raw = F.least(raw, F.lit(float(max_position_weight)))
    return out.withColumn("weight", raw).drop("_k", "_floor", "_sum")


def holding_returns(
    weights: DataFrame, prices: DataFrame, dates: DataFrame | None = None, entity: str = "ticker", delay: int = 1, offset: int = 0, tolerance: int = 0
) -> DataFrame:
    """Fate and return of every weight of one portfolio (see ``holdings.outcomes``), with its decision ``date``."""
    days = sessions(prices) if dates is None else dates
    plan = cut_lineage(schedule(weights, days, [("only", offset, delay)], tolerance))
    when = plan.select("plan", "period", "date")
    target = weights.select(entity, "date", "weight").join(F.broadcast(when), "date")  # one row per rebalance
    held = outcomes(target.withColumn("run", F.lit("only")), prices, days, plan, tolerance, entity)
    return held.join(F.broadcast(when), ["plan", "period"])


def period_returns(
    weights: DataFrame, prices: DataFrame, dates: DataFrame | None = None, entity: str = "ticker", bps: float = ONE_WAY_BPS,
    delay: int = 1, offset: int = 0, tolerance: int = 0,
) -> DataFrame:
    """Per rebalance: gross return until the next execution, turnover against drifted weights, cost, net return, and the fates of its names.

    Bought ``delay`` sessions after the decision. A name that stops trading is sold at its last price or written off, never carried at
    zero return; a name without a price on the execution is not bought. The last period is open and has no return.
    """
    held = cut_lineage(holding_returns(weights, prices, dates, entity, delay, offset, tolerance))
    costs = weights.sparkSession.createDataFrame([("only", float(bps))], "run string, bps double")
    when = held.select("period", "date").distinct()  # one row per rebalance
    return run_periods(held, costs, entity).join(F.broadcast(when), "period").drop("run", "period")


def tranche_weights(weights: DataFrame, tranches: int, entity: str = "ticker") -> DataFrame:
    """Stagger a portfolio over ``tranches``: each rebalance renews one of them, the others keep their names."""
    idx = session_index(weights.select("date").distinct())  # one row per rebalance
    held = weights.select(entity, "date", "weight").join(F.broadcast(idx), "date")
    spread = held.withColumn("idx", F.explode(F.sequence(F.col("idx"), F.col("idx") + tranches - 1))).drop("date")
    out = spread.groupBy(entity, "idx").agg((F.sum("weight") / tranches).alias("weight"))
    return out.join(F.broadcast(idx), "idx").select(entity, "date", "weight")


def top_n_mean(df: DataFrame, score: str, target: str, n: int) -> DataFrame:
    """Mean target of the best ``n`` distinct scores of each date, and its compounded path."""
    place = F.dense_rank().over(Window.partitionBy("date").orderBy(F.col(score).desc()))
    best = df.where(F.col(score).isNotNull()).withColumn("_p", place).where(F.col("_p") <= n)
    per = best.groupBy("date").agg(F.avg(target).alias("mean_return"), F.count(F.lit(1)).alias("n_names"))
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per date
    return per.withColumn("growth", F.product(1.0 + F.coalesce("mean_return", F.lit(0.0))).over(upto))


def contributors(weights: DataFrame, returns: DataFrame, by: str, k: int, entity: str = "ticker") -> DataFrame:
    """Largest and smallest total contributions by name or sector."""
    parts = weights.join(returns.select(entity, "date", "ret"), [entity, "date"])
    total = parts.groupBy(by).agg(F.sum(F.col("weight") * F.col("ret")).alias("contribution"))
    top = total.orderBy(F.col("contribution").desc(), F.col(by)).limit(k).withColumn("side", F.lit("top"))
    low = total.orderBy(F.col("contribution").asc(), F.col(by)).limit(k).withColumn("side", F.lit("bottom"))
    return top.transform(stacked, low)
