"""Appraisal of companies: every valuation method of a company's business model, why a method does not count, and the blended range.

Methods are rows, not branches: a company is spread over the two to four methods its model weighs, each row picks its value from
results that were computed once for all companies, and one aggregation blends what is usable. Everything joins on the company.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstone.functions.numeric import TINY, div, finite, mapped
from panelstone.operators import valuation as V
from panelstone.session import cut_lineage

# A value outside these multiples of the price speaks of bad data.
PLAUSIBLE = (0.05, 10.0)


def latest(panel: DataFrame) -> DataFrame:
    """Each company's last row; of several on its last date the greatest by all values that can be ordered."""
    rest = [x for x in panel.columns if x != "company_id"]
    last = panel.groupBy("company_id").agg(F.max_by(F.struct(*rest), F.struct("date", F.xxhash64(*rest))).alias("_r"))
    return last.select("company_id", "_r.*")


def cash_flow_values(subjects: DataFrame) -> DataFrame:
    """``company_id, dcf_bear, dcf_base, dcf_bull, terminal_share, contradicts_fcf, ev_negative``; no row where nothing can be projected."""
    out = V.run_scenarios(subjects)
    at = lambda scenario, value: F.max(F.when(F.col("scenario") == scenario, F.col(value)))
    base = ("terminal_share", "contradicts_fcf", "ev_negative")
    return out.groupBy("company_id").agg(
        *[at(s, "value_per_share").alias(f"dcf_{s}") for s in ("bear", "base", "bull")], *[at("base", x).alias(x) for x in base]
    )


def sector_value() -> Column:
    """Value per share by the model that only one kind of business has."""
    extra = F.when(F.col("business_model") == "unprofitable_growth", V.UNCERTAINTY_PREMIUM).otherwise(0.0)
    coe = V.cost_of_equity("beta", F.coalesce("risk_free_rate", F.lit(V.RISK_FREE)), "market_cap", extra)
    insurer = F.col("business_model") == "insurer"
    return (
        F.when(F.col("method") == "residual_income", F.when(insurer, V.insurer_value(coe)).otherwise(V.bank_value(coe)))
        .when(F.col("method") == "nav_affo", V.reit_value())
        .when(F.col("method") == "normalized_earnings", V.normalised_value())
    )


def method_outcomes(subjects: DataFrame, panel: DataFrame, min_peers: int = V.MIN_PEERS, min_observations: int = 500) -> DataFrame:
    """One row per company and method of its business model: value, range, weight, whether it counts and, if not, why.

    ``subjects`` has one row per company with ``add_consensus``, ``own_medians`` and the cash-flow values attached; ``panel`` holds all
    companies on the subjects' dates (peers) and earlier (own history). A company of an unknown model has no methods.
    """
    dates = F.broadcast(subjects.select("date").distinct())  # one row per session
    peers = panel.join(dates, "date", "left_semi")
    relative = cut_lineage(V.comparables(peers, min_peers).select("company_id", "date", F.col("value_per_share").alias("_rel"), "value_low", "value_high"))
    typical = V.own_history(panel, list(V.HISTORY_ORDER), min_observations=min_observations)
    own = cut_lineage(V.historical(subjects, typical).select("company_id", F.col("value_per_share").alias("_own")))
    methods = mapped("business_model", {model: list(weights) for model, weights in V.METHOD_WEIGHTS.items()})
    rows = subjects.withColumn("method", F.explode(methods))
    rows = rows.join(relative, ["company_id", "date"], "left").join(own, "company_id", "left")
    by = lambda name: F.col("method") == name
    value = F.when(by("dcf"), F.col("dcf_base")).when(by("comparables"), F.col("_rel")).when(by("historical"), F.col("_own")).otherwise(sector_value())
    rows = rows.withColumns({"value": finite(value), "halve": by("historical") & V.regime_change()})
    ratio = div("value", F.when(F.col("price") > TINY, F.col("price")))
    reason = (
        F.when(F.col("value").isNull(), mapped("method", {"dcf": "no projection", "comparables": "no usable peer multiple", "historical": "no usable history"}, "no sector value"))
        .when(by("dcf") & F.col("contradicts_fcf"), "contradicts reported cash flow")
        .when(by("dcf") & F.col("ev_negative"), "no value in the business")
        .when(~ratio.between(*PLAUSIBLE), "implausible against the price")
    )
    only = lambda name: F.when(by("comparables"), F.col(name))
    return rows.select(
        "company_id", "method", (V.method_weight() * F.when(F.col("halve") & F.col("value").isNotNull(), 0.5).otherwise(1.0)).alias("weight"),
        "value", only("value_low").alias("low"), only("value_high").alias("high"), reason.isNull().alias("usable"),
        (F.col("halve") & F.col("value").isNotNull()).alias("halve"), reason.alias("reason"),
    )


def prepared(panel: DataFrame) -> DataFrame:
    """The companies to appraise: last rows with reinvestment efficiency, consensus path, growth, own medians and cash-flow values."""
    last = cut_lineage(latest(panel))
    dates = F.broadcast(last.select("date").distinct())  # one row per session
    spent = V.sales_to_capital(panel.join(dates, "date", "left_semi")).select("company_id", "date", "sales_to_capital")
    subjects = last.drop("sales_to_capital").join(spent, ["company_id", "date"], "left").join(V.own_medians(panel), "company_id", "left")
    subjects = cut_lineage(V.add_consensus(subjects.withColumn("growth_rate", V.growth_estimate())))
    return cut_lineage(subjects.join(cash_flow_values(subjects), "company_id", "left"))


def appraise(panel: DataFrame, min_peers: int = V.MIN_PEERS, min_observations: int = 500) -> tuple[DataFrame, DataFrame]:
    """``(methods, companies)``: the outcome of every method, and per company the blended value, range, confidence, class and caveats.

    Every company of ``panel`` has its row, with nulls and no confidence where no method counts. The scenario range and the
    sensitivities of a projection that was withdrawn do not reach the result.
    """
    subjects = prepared(panel)
    methods = cut_lineage(method_outcomes(subjects, panel, min_peers, min_observations))
    out = V.blend(methods.drop("weight", "reason"), subjects)
    swings = V.sensitivity(subjects.drop("terminal_share", "contradicts_fcf", "ev_negative"), ["company_id"])
    worst = swings.groupBy("company_id").agg(F.max("swing_pct").alias("worst_swing"))
    used = F.coalesce("dcf_used", F.lit(False))
    out = out.join(worst, "company_id", "left").withColumns(
        {"has_dcf": used, "worst_swing": F.when(used, F.col("worst_swing")), "terminal_share": F.when(used, F.col("terminal_share"))}
    )
    out = out.withColumn("confidence", V.valuation_confidence())
    return methods, out.withColumns({"classification": V.classify(), "caveats": V.valuation_caveats()})
