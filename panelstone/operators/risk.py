"""Risk composite, financial-strength scores, value-trap signals and confidence, all as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstone.functions.numeric import banded, clip, div, either, mapped
from panelstone.functions.spec import (
    CONFIDENCE_LABELS,
    CONFIDENCE_WEIGHTS,
    DISTRESS_LABELS,
    NON_FINANCIAL,
    PREDICTABILITY,
    RISK_COMPONENTS,
    RISK_LABELS,
    TRAP_LABELS,
    TRAP_WEIGHTS,
)
from panelstone.operators.ranking import rank_long


def distress_label(z) -> Column:
    return banded(z, DISTRESS_LABELS, "Distress zone", "Not assessed")


def risk_label(score) -> Column:
    return banded(score, RISK_LABELS, "Low", "Not assessed")


def confidence_label(score) -> Column:
    return banded(score, CONFIDENCE_LABELS, "Very low", None)


def altman_z() -> Column:
    """Five-ratio distress score, for business models whose balance sheet it describes."""
    assets = F.when(F.col("assets") > 0, F.col("assets"))
    owed = either("liabilities", F.col("assets") - either("equity_incl_nci", "equity"))
    owed = F.when(owed > 0, owed)
    z = (
        1.2 * div(F.col("current_assets") - F.col("current_liabilities"), assets)
        + 1.4 * div("retained_earnings", assets)
        + 3.3 * div("ebit", assets)
        + 0.6 * div("market_cap", owed)
        + div("revenue", assets)
    )
    return F.when(F.col("business_model").isin(list(NON_FINANCIAL)), z)


def piotroski() -> Column:
    """Nine pass/fail tests of improvement; a test whose inputs are missing does not pass.

    The dilution test passes when the share count did not grow (``share_count_change`` <= 0).
    """
    col = F.col
    prior_assets = F.when(col("assets__lag1y") > 0, col("assets__lag1y"))
    tests = [
        col("net_income") > 0,
        col("operating_cash_flow") > 0,
        div("net_income", "assets") > div("net_income__lag1y", prior_assets),
        col("operating_cash_flow") > col("net_income"),
        div("total_debt", "assets") < div("total_debt__lag1y", prior_assets),
        col("current_ratio") > col("current_ratio__lag1y"),
        col("share_count_change") <= 0,
        col("gross_margin") > col("gross_margin__lag1y"),
        div("revenue", "assets") > div(F.when(col("revenue__lag1y") != 0, col("revenue__lag1y")), prior_assets),
    ]
    total = reduce(add, [F.when(t, 1).otherwise(0) for t in tests])
    known = col("net_income").isNotNull() & col("operating_cash_flow").isNotNull() & (col("assets") > 0)
    return F.when(known, total)


def build_risk(panel: DataFrame, ids: tuple[str, ...] = ("company_id", "date")) -> DataFrame:
    """Distress and strength scores plus a 0-100 percentile blend within the date (higher is riskier)."""
    out = panel.withColumns({"distress_score": altman_z(), "piotroski": piotroski()})
    parts = [(m, w, d) for m, w, d in RISK_COMPONENTS if m in out.columns]
    long = rank_long(out, list(ids), ["date"], [m for m, _, _ in parts])
    weight = mapped("metric", {m: w for m, w, _ in parts})
    falling = [m for m, _, d in parts if d < 0]
    pct = F.when(F.col("metric").isin(falling), 1.0 - F.col("percentile")).otherwise(F.col("percentile"))
    blend = long.groupBy(*ids).agg((F.sum(pct * weight) / F.sum(weight) * 100.0).alias("risk_score"))
    return out.join(blend, list(ids), "left").withColumns(
        {"risk_label": risk_label("risk_score"), "distress_label": distress_label("distress_score")}
    )


def trap_signals() -> dict[str, tuple[Column, Column]]:
    """Signal -> (fired, observed value). A missing input never fires; dilution fires on a growing share count."""
    col = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    return {
        "revenue_declining": (yes(col("revenue_growth_1y") < -0.01), col("revenue_growth_1y")),
        "margin_eroding": (yes(col("margin_trend") < -0.02), col("margin_trend")),
        "fcf_deteriorating": (yes(col("free_cash_flow") < 0) | yes(col("fcf_growth_3y") < -0.15), col("fcf_growth_3y")),
        "negative_revisions": (yes(col("eps_revision_3m") < -0.2), col("eps_revision_3m")),
        "excessive_debt": (yes(col("net_debt_to_ebitda") > 4.0), col("net_debt_to_ebitda")),
        "weak_interest_cover": (yes(col("interest_coverage") < 3.0), col("interest_coverage")),
        "persistent_dilution": (yes(col("share_count_change") > 0.02), col("share_count_change")),
        "weak_relative_strength": (yes(col("rel_strength_spy") < -0.20), col("rel_strength_spy")),
        "below_long_average": (yes((col("px_over_ma200") < 0) & (col("ma200_slope") < 0)), col("px_over_ma200")),
        "accounting_quality": (yes(col("accrual_ratio") > 0.08), col("accrual_ratio")),
        "distress_risk": (yes(col("distress_score") < 1.8), col("distress_score")),
        "falling_returns": (yes(col("roic") - col("roic__lag1y") < -0.03), col("roic")),
    }


def assess_value_traps(panel: DataFrame, valuation_class: str = "valuation_class", quality: str = "quality") -> DataFrame:
    """Trap score, number of fired signals, the signals themselves and the resulting situation."""
    signals = trap_signals()
    fired = reduce(add, [F.when(f, TRAP_WEIGHTS[k]).otherwise(0.0) for k, (f, _) in signals.items()])
    count = reduce(add, [f.cast("int") for f, _ in signals.values()])
    listed = F.array(*[F.struct(F.lit(k).alias("key"), f.alias("fired"), v.cast("double").alias("value")) for k, (f, v) in signals.items()])
    out = panel.withColumns(
        {"trap_score": 100.0 * fired / sum(TRAP_WEIGHTS.values()), "n_fired": count, "signals": listed}
    ).withColumn("classification", classify_trap("trap_score", valuation_class, quality))
    return out.withColumn("classification_label", mapped("classification", TRAP_LABELS))


def classify_trap(score: str, valuation_class: str, quality: str) -> Column:
    s = F.col(score)
    good = F.coalesce(F.col(quality) >= 65.0, F.lit(False))
    cheap = F.coalesce(F.col(valuation_class).isin("significantly_undervalued", "undervalued"), F.lit(False))
    dear = F.coalesce(F.col(valuation_class).isin("significantly_overvalued", "overvalued"), F.lit(False))
    return (
        F.when(cheap & (s >= 35.0), "possible_trap")
        .when(cheap & ((s >= 18.0) | ~good), "speculative_value")
        .when(cheap, "attractive_value")
        .when(dear & (s >= 30.0), "deteriorating_expensive")
        .when(dear & good, "quality_compounder_expensive")
        .when(dear & (s >= 20.0), "deteriorating_expensive")
        .otherwise("neutral")
    )


def unit(x: Column) -> Column:
    return clip(x, 0.0, 1.0)


def confidence_components() -> dict[str, Column]:
    """Six 0-1 components; an unknown input takes a declared neutral value, never zero."""
    age, n = F.col("data_age_days"), F.col("n_analysts")
    tiers = F.when(age <= 45, 1.0).when(age <= 100, 0.85).when(age <= 140, 0.6)
    return {
        "data_completeness": unit(either("metric_coverage", 0.5)),
        "data_freshness": F.when(age.isNull(), 0.5).otherwise(tiers.otherwise(unit(0.4 - (age - 140) / 500.0))),
        "valuation_agreement": either(unit(F.col("valuation_confidence")), 0.35),
        "score_stability": either(unit(1.0 - F.abs("score_change_1m") / 40.0), 0.6),
        "business_predictability": F.coalesce(mapped("business_model", PREDICTABILITY, 0.6), F.lit(0.6)),
        "analyst_coverage": F.when(n.isNull(), 0.5).when(n >= 15, 1.0).when(n >= 8, 0.8).when(n >= 3, 0.55).otherwise(0.3),
    }


def confidence_caveats() -> Column:
    """Which evidence is thin, in a fixed order and without repeats."""
    flags = [
        (F.coalesce(F.col("metric_coverage") < 0.6, F.lit(False)), "few scoring inputs"),
        (F.coalesce(F.col("data_age_days") > 140, F.lit(False)), "stale financials"),
        (F.col("valuation_confidence").isNull(), "no fair value"),
        (F.coalesce(F.abs("score_change_1m") > 20, F.lit(False)), "score moved sharply"),
        (mapped("business_model", PREDICTABILITY, 0.6) <= 0.5, "hard to forecast"),
        (F.coalesce(F.col("n_analysts") < 3, F.lit(False)), "thin coverage"),
    ]
    listed = F.array(*[F.when(cond, F.lit(text)) for cond, text in flags])
    return F.array_distinct(F.filter(listed, lambda x: x.isNotNull()))


def add_confidence(df: DataFrame) -> DataFrame:
    """Weighted confidence with its label, components and caveats."""
    parts = confidence_components()
    total = unit(reduce(add, [x * CONFIDENCE_WEIGHTS[k] for k, x in parts.items()]))
    listed = F.array(*[F.struct(F.lit(k).alias("key"), x.alias("score"), F.lit(CONFIDENCE_WEIGHTS[k]).alias("weight")) for k, x in parts.items()])
    return df.withColumns(
        {"confidence": total, "confidence_components": listed, "confidence_caveats": confidence_caveats()}
    ).withColumn("confidence_label", confidence_label("confidence"))


def attach_confidence(scores: DataFrame, context: DataFrame) -> DataFrame:
    """Confidence for the latest date only; earlier dates carry null."""
    newest = scores.agg(F.max("date").alias("_newest"))
    current = scores.join(F.broadcast(newest), F.col("date") == F.col("_newest"), "left_semi")
    judged = add_confidence(current.join(context, "company_id", "left")).select("company_id", "date", "confidence", "confidence_label")
    return scores.join(judged, ["company_id", "date"], "left")
