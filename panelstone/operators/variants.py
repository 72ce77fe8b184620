"""Robustness of a ranked portfolio: every variant is a parameter row, and all of them run in one plan."""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelstone.operators.holdings import BOUGHT, outcomes, run_growth, run_periods, schedule
from panelstone.operators.portfolio import ONE_WAY_BPS
from panelstone.operators.verdicts import robustness_verdict
from panelstone.session import cut_lineage

BASE, SHIFT = "base", "rebalance_shift"


@dataclass(frozen=True)
class Variant:
    """One run of a strategy; what is not named is as in the base run."""

    test: str
    variant: str
    top_n: int = 20
    max_sector_weight: float | None = None
    weighting: str = "equal"
    delay: int = 1
    offset: int = 0
    cost_factor: float = 1.0
    drop_top: int = 0

    @property
    def plan(self) -> str:
        return f"offset {self.offset} delay {self.delay}"


# The declared variants.
BATTERY = (
    Variant("double_costs", "2x", cost_factor=2.0),
    Variant("double_costs", "4x", cost_factor=4.0),
    Variant("execution_delay", "2 days", delay=2),
    Variant("execution_delay", "3 days", delay=3),
    Variant("execution_delay", "5 days", delay=5),
    Variant("rebalance_shift", "-5 days", offset=-5),
    Variant("rebalance_shift", "-1 day", offset=-1),
    Variant("rebalance_shift", "+1 day", offset=1),
    Variant("rebalance_shift", "+5 days", offset=5),
    Variant("drop_winners", "drop top 1", drop_top=1),
    Variant("drop_winners", "drop top 3", drop_top=3),
    Variant("drop_winners", "drop top 5", drop_top=5),
    Variant("sector_cap", "30%", max_sector_weight=0.30),
    Variant("sector_cap", "20%", max_sector_weight=0.20),
    Variant("weighting", "score-proportional", weighting="score_proportional"),
    Variant("threshold", "15 names", top_n=15),
    Variant("threshold", "25 names", top_n=25),
    Variant("threshold", "30 names", top_n=30),
)


def parameter_rows(spark: SparkSession, variants: tuple[Variant, ...]) -> DataFrame:
    """The variants as rows, with the plan each one trades by and the names a sector may hold."""
    ddl = "test string, variant string, top_n int, max_sector_weight double, weighting string, delay int, offset int, cost_factor double, drop_top int"
    assert [x.split()[0] for x in ddl.split(", ")] == [f.name for f in fields(Variant)]
    rows = [(*astuple(v), v.plan, v.top_n if v.max_sector_weight is None else max(1, int(v.top_n * v.max_sector_weight))) for v in variants]
    return spark.createDataFrame(rows, f"{ddl}, plan string, per_sector int")


def front(ranked: DataFrame, variants: tuple[Variant, ...], entity: str = "ticker") -> DataFrame:
    """The best of each strategy, date and sector, as many as any of the variants can come to hold there."""
    reach = max(v.top_n for v in variants) + max(v.drop_top for v in variants)
    place = F.row_number().over(Window.partitionBy("strategy", "date", "sector").orderBy(F.col("score").desc(), F.col(entity)))
    return ranked.where(F.col("score").isNotNull()).withColumn("_r", place).where(F.col("_r") <= reach).drop("_r")


def target_weights(ranked: DataFrame, variants: tuple[Variant, ...], plan: DataFrame, excluded: DataFrame | None = None, entity: str = "ticker") -> DataFrame:
    """Target weights of every strategy, variant and period: ``strategy, test, variant, run, plan, period, entity, weight``.

    ``ranked``: ``strategy, date, entity, sector, score``, unique by strategy, date and entity; rows without a score are left out, ties go
    to the smaller entity. ``excluded``: ``strategy, entity, place``, the names a variant with ``drop_top >= place`` may not hold.
    A sector's best are cut before they meet the variants, so what fans out is bounded by variants x sectors x names held.
    """
    best = [F.col("score").desc(), F.col(entity)]
    few = front(ranked, variants, entity)
    runs = parameter_rows(ranked.sparkSession, variants).select("test", "variant", "plan", "top_n", "per_sector", "weighting", "drop_top")
    when = plan.select("plan", "period", "date").join(F.broadcast(runs), "plan")
    rows = few.join(F.broadcast(when), "date")  # variants x rebalances: declared rows times the calendar
    if excluded is not None:
        rows = rows.join(F.broadcast(excluded.select("strategy", entity, "place")), ["strategy", entity], "left")  # drop_top names a strategy
        rows = rows.where(F.col("place").isNull() | (F.col("place") > F.col("drop_top"))).drop("place")
    run = ["strategy", "test", "variant", "period"]
    rows = rows.withColumn("_s", F.row_number().over(Window.partitionBy(*run, "sector").orderBy(*best))).where(F.col("_s") <= F.col("per_sector"))
    rows = rows.withColumn("_p", F.row_number().over(Window.partitionBy(*run).orderBy(*best))).where(F.col("_p") <= F.col("top_n"))
    whole = Window.partitionBy(*run)  # at most top_n names
    n, floor = F.count(F.lit(1)).over(whole), F.min("score").over(whole)
    room = F.sum("score").over(whole) - n * floor
    rows = rows.withColumns({"_n": n, "_floor": floor, "_room": room})
    by_score = (F.col("weighting") == "score_proportional") & (F.col("_room") > 1e-12)
    weight = F.when(by_score, (F.col("score") - F.col("_floor")) / F.col("_room")).otherwise(1.0 / F.col("_n"))
    name = F.concat_ws("|", "strategy", "test", "variant").alias("run")
    return rows.select("strategy", "test", "variant", name, "plan", "period", entity, weight.alias("weight"))


def winners(held: DataFrame, k: int, entity: str = "ticker") -> DataFrame:
    """The ``k`` names of each strategy that contributed most: ``strategy, entity, place``; ties go to the smaller entity."""
    total = held.where(F.col("state").isin(*BOUGHT)).groupBy("run", entity).agg(F.round(F.sum(F.col("weight") * F.col("ret")), 9).alias("_c"))
    place = F.row_number().over(Window.partitionBy("run").orderBy(F.col("_c").desc(), F.col(entity)))
    return total.withColumn("place", place).where(F.col("place") <= k).select(F.split_part("run", F.lit("|"), F.lit(1)).alias("strategy"), entity, "place")


def robustness(
    ranked: DataFrame, prices: DataFrame, dates: DataFrame, benchmark: DataFrame, variants: tuple[Variant, ...] = BATTERY,
    base: Variant = Variant(BASE, BASE), tolerance: int = 0, bps: float = ONE_WAY_BPS, entity: str = "ticker",
) -> DataFrame:
    """Every variant run again beside its base: ``strategy, test, variant, cagr, excess, base_excess, verdict``.

    The base runs once by itself only where a variant leaves out its best names; otherwise it is one more row of the one plan. A strategy
    name holds no ``|``. Whatever has no closed period in a run has no row for it.
    """
    spark = ranked.sparkSession
    every = (base, *variants)
    plans = sorted({(v.plan, v.offset, v.delay) for v in every})
    dates = cut_lineage(dates.select("date"))
    plan = cut_lineage(schedule(cut_lineage(ranked.select("date").distinct()), dates, plans, tolerance))
    ranked = cut_lineage(front(ranked, every, entity))  # all rows are ranked once, for the base run and for the variants
    k = max(v.drop_top for v in every)
    gone = None
    if k:
        first = outcomes(target_weights(ranked, (base,), plan, entity=entity), prices, dates, plan.where(F.col("plan") == base.plan), tolerance, entity)
        gone = cut_lineage(winners(first, k, entity))
    weights = cut_lineage(target_weights(ranked, every, plan, gone, entity))
    held = cut_lineage(outcomes(weights, prices, dates, plan, tolerance, entity))
    names = weights.select("run", "strategy", "test", "variant").distinct()  # strategies x declared variants
    factors = parameter_rows(spark, every).select("test", "variant", (F.col("cost_factor") * bps).alias("bps"))
    names = names.join(F.broadcast(factors), ["test", "variant"])
    growth = run_growth(run_periods(held, names.select("run", "bps"), entity), benchmark).join(F.broadcast(names.drop("bps")), "run")
    growth = cut_lineage(growth.select("strategy", "test", "variant", "cagr", "excess"))
    own = growth.where(F.col("test") == base.test).select("strategy", F.col("excess").alias("base_excess"))
    out = growth.where(F.col("test") != base.test).join(F.broadcast(own), "strategy", "left")
    return out.withColumn("verdict", robustness_verdict("base_excess", "excess", F.col("test") == SHIFT))
