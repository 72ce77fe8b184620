"""Valuation as columns: scenario cash flows, peer and own-history multiples, sector models, and their blend.

A projection is a fold over ten years inside one row, so scenarios and sensitivities cost rows, never shuffles. Peer statistics
leave the subject out through order statistics of its group; pairs of companies are never formed.
"""

from __future__ import annotations

from functools import reduce
from operator import add, mul, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstone.functions.numeric import TINY, clip, div, either, finite, inside, mapped, zero_if_null
from panelstone.operators.ranking import annotate, holds, ladder
from panelstone.session import cut_lineage

# Discounting.
RISK_FREE, EQUITY_PREMIUM, BETA_RANGE = 0.042, 0.050, (0.60, 2.00)
SIZE_PREMIUM, SIZE_LIMIT, RATE_RANGE, UNCERTAINTY_PREMIUM = 0.010, 1e10, (0.055, 0.160), 0.015
# Projection.
YEARS, TERMINAL_GROWTH, TERMINAL_CAP = 10, 0.025, 0.035
TAX_RANGE, TAX_DEFAULT = (0.10, 0.35), 0.21
CAPITAL_RANGE, CAPITAL_DEFAULT = (0.8, 6.0), 2.0
MIN_REVENUE_ANALYSTS, MARGIN_CEILING, FCF_CONTRADICTION = 5, 0.25, 0.10
# Scenario, growth multiple, margin shift, fade strength, terminal shift, rate shift, consensus side.
SCENARIOS = (
    ("bear", 0.55, -0.025, 1.35, -0.010, 0.015, "low"),
    ("base", 1.00, 0.0, 1.00, 0.0, 0.0, "mid"),
    ("bull", 1.35, 0.025, 0.75, 0.005, -0.010, "high"),
)
# Peer multiples.
MIN_PEERS, PEER_TRIM, MAX_ADJUSTMENT, MAX_MULTIPLE_RATIO = 6, 0.20, 0.30, 4.0
ENTERPRISE = {"ev_ebit": "ebit", "ev_ebitda": "ebitda", "ev_revenue": "revenue"}
EQUITY_LEVEL = {"forward_pe": "forward_earnings", "trailing_pe": "net_income", "price_to_book": "equity"}
DEFAULT_MULTIPLES = ("ev_ebit", "ev_ebitda", "fcf_yield", "forward_pe")
MULTIPLES_FOR = {
    "bank": ("price_to_book", "trailing_pe", "forward_pe"),
    "insurer": ("price_to_book", "trailing_pe", "forward_pe"),
    "cyclical": ("ev_revenue", "price_to_book", "ev_ebitda", "ev_ebit"),
    "unprofitable_growth": ("ev_revenue", "fcf_yield"),
}
HISTORY_ORDER = ("ev_ebit", "ev_ebitda", "trailing_pe", "price_to_book")
HISTORY_TRIM = 0.10
# Method weights by business model.
METHOD_WEIGHTS = {
    "operating": {"dcf": 0.50, "comparables": 0.30, "historical": 0.20},
    "bank": {"residual_income": 0.45, "comparables": 0.30, "historical": 0.25},
    "insurer": {"residual_income": 0.40, "comparables": 0.30, "historical": 0.30},
    "reit": {"nav_affo": 0.50, "comparables": 0.25, "historical": 0.25},
    "cyclical": {"normalized_earnings": 0.40, "dcf": 0.20, "comparables": 0.20, "historical": 0.20},
    "unprofitable_growth": {"dcf": 0.60, "comparables": 0.40},
}
# Classification.
CLASS_STEPS, REFERENCE_WIDTH, MAX_WIDTH, MIN_CONFIDENCE = (0.30, 0.12, -0.12, -0.30), 0.60, 2.0, 0.35


def risk_free_rate(yields: DataFrame, date: str = "date", value: str = "close") -> DataFrame:
    """Latest yield in percent as a fraction when it lies between 0.1 % and 20 %, else the fallback (one row)."""
    last = yields.agg((F.max_by(value, date) / 100.0).alias("_y"))
    return last.select(F.coalesce(inside("_y", 0.001, 0.20), F.lit(RISK_FREE)).alias("risk_free_rate"))


def cost_of_equity(beta, risk_free, market_cap, extra=0.0) -> Column:
    """Capital-asset-pricing rate with a bounded beta, a size premium and a bounded result."""
    b = clip(F.coalesce(finite(beta), F.lit(1.0)), *BETA_RANGE)
    extra = extra if isinstance(extra, Column) else F.lit(float(extra))
    small = F.when(F.coalesce(F.col(market_cap) < SIZE_LIMIT, F.lit(False)), SIZE_PREMIUM).otherwise(0.0)
    rf = F.col(risk_free) if isinstance(risk_free, str) else risk_free
    return clip(rf + b * EQUITY_PREMIUM + extra + small, *RATE_RANGE)


def sales_to_capital(panel: DataFrame) -> DataFrame:
    """Revenue added per unit of capital spent over the longest usable window; then the sector median; then the book ratio."""
    from panelstone.operators.ranking import group_quantiles

    spend = F.greatest(zero_if_null("capex"), F.lit(0.0)) + F.greatest(zero_if_null("acquisitions"), F.lit(0.0))

    def window(y: int) -> Column:
        gain = F.col("revenue") - F.col(f"revenue__lag{y}y")
        return inside(F.when((gain > 0) & (spend > 0), div(gain, spend * y)), 0.1, 20.0)

    out = panel.withColumn("_own", F.coalesce(*[window(y) for y in (5, 3, 1)]))
    sector = group_quantiles(out, ["date", "sector"], "_own", linear={"_mid": 0.5}).drop("n")
    book = F.when((F.col("revenue") > 0) & (F.col("invested_capital") > 0), div("revenue", "invested_capital"))
    out = out.join(sector, ["date", "sector"], "left")
    return out.withColumn("sales_to_capital", F.coalesce("_own", "_mid", inside(book, 0.1, 20.0))).drop("_own", "_mid")


def growth_estimate() -> Column:
    """Trailing and forward growth blended 45/55, either alone when the other is missing, 3 % when both are."""
    t, f = finite("revenue_growth"), finite("forward_eps_growth")
    return F.when(t.isNull() & f.isNull(), 0.03).otherwise(clip(F.coalesce(0.45 * t + 0.55 * f, t, f), -0.25, 0.40))


def add_consensus(df: DataFrame) -> DataFrame:
    """Consensus revenue levels, the operating margin consensus earnings imply, and the low/high ratios of the far year."""
    tax = clip(either("tax_rate", TAX_DEFAULT), 0.0, 0.60)
    added = zero_if_null("amortization_intangibles") + zero_if_null("share_based_comp")
    ratio = F.when((added > 0) & (F.col("revenue") > 0), div(added, "revenue")).otherwise(0.0)

    def margin(revenue: str, eps: str) -> Column:
        return inside(div(div(F.col(eps) * F.col("shares"), 1.0 - tax), revenue) - ratio, 0.0, 0.90)

    r1 = F.when(F.col("consensus_revenue_this_year") > 0, F.col("consensus_revenue_this_year"))
    r2 = F.when(r1.isNotNull() & (F.col("consensus_revenue_next_year") > 0), F.col("consensus_revenue_next_year"))
    far = F.coalesce(r2, r1)
    has = F.col("revenue") > 0
    return df.withColumns(
        {
            "level_1": F.when(has, r1),
            "level_2": F.when(has, r2),
            "cmargin_1": F.when(has & r1.isNotNull(), margin("consensus_revenue_this_year", "consensus_eps_this_year")),
            "cmargin_2": F.when(has & r2.isNotNull(), margin("consensus_revenue_next_year", "forward_eps")),
            "low_ratio": F.coalesce(clip(div("consensus_revenue_next_low", far), 0.4, 1.0), F.lit(1.0)),
            "high_ratio": F.coalesce(clip(div("consensus_revenue_next_high", far), 1.0, 2.5), F.lit(1.0)),
        }
    )


def with_scenarios(df: DataFrame) -> DataFrame:
    """One row per company and scenario (three declared rows)."""
    names = ("scenario", "growth_multiple", "margin_shift", "fade_strength", "terminal_shift", "rate_shift", "side")
    cells = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, s)]) for s in SCENARIOS])
    return df.withColumn("_s", F.explode(cells)).select("*", "_s.*").drop("_s")


def _fade(start: Column, end: Column, t: Column, n: Column, strength: Column) -> Column:
    """From start to end over n years; strength above one arrives sooner."""
    progress = F.pow(F.least(F.greatest(div(t, n), F.lit(0.0)), F.lit(1.0)), div(1.0, strength))
    return F.when(n > 0, start + (end - start) * progress).otherwise(end)


def project(df: DataFrame) -> DataFrame:
    """Ten-year projection per row; needs the scenario columns and the company's own figures.

    Rows that cannot be projected (no positive revenue, shares or margin) are dropped. Adds the value per share, its parts, the
    contradiction and negative-value flags, and the years as an array.
    """
    col = F.col
    for name in ("level_1", "level_2", "cmargin_1", "cmargin_2", "n_revenue_analysts", "reported_free_cash_flow", "minority_interest", "preferred_equity", "roic", "risk_free_rate"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("double"))
    for name in ("low_ratio", "high_ratio"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(1.0))
    ok = (col("revenue") > 0) & (col("shares") > 0) & finite("operating_margin").isNotNull()
    rf = F.coalesce(col("risk_free_rate"), F.lit(RISK_FREE))
    out = df.where(ok).withColumn("rate", cost_of_equity("beta", rf, "market_cap", col("rate_shift")))
    out = out.withColumns(
        {
            "g_end": F.least(F.lit(TERMINAL_GROWTH) + col("terminal_shift"), F.lit(TERMINAL_CAP), col("rate") - 0.01),
            "g_start": clip(zero_if_null("growth_rate") * col("growth_multiple"), -0.25, 0.40),
            "tax": clip(F.when(col("tax_rate") != 0, col("tax_rate")), *TAX_RANGE),
            "s2c": clip(F.coalesce(F.when(col("sales_to_capital") != 0, col("sales_to_capital")), F.lit(CAPITAL_DEFAULT)), *CAPITAL_RANGE),
        }
    ).withColumn("tax", F.coalesce("tax", F.lit(TAX_DEFAULT)))
    # Consensus path: levels scaled toward the low or high end, used only with enough analysts and when it shows growth.
    far = F.when(col("side") == "low", col("low_ratio")).when(col("side") == "high", col("high_ratio")).otherwise(1.0)
    two = col("level_2").isNotNull()
    c1 = col("level_1") * F.when(two, 1.0 + (far - 1.0) / 2.0).otherwise(far)
    c2 = col("level_2") * far
    last = F.coalesce(c2, c1)
    usable = F.coalesce((zero_if_null("n_revenue_analysts") >= MIN_REVENUE_ANALYSTS) & (last > col("revenue")), F.lit(False))
    out = out.withColumns(
        {
            "_h": F.when(~usable, 0).when(two, 2).otherwise(1),
            "_c1": c1,
            "_c2": c2,
        }
    )
    known = F.when(col("_h") == 2, col("cmargin_1").isNotNull() & col("cmargin_2").isNotNull()).otherwise(col("cmargin_1").isNotNull())
    ceiling = col("operating_margin") + MARGIN_CEILING
    out = out.withColumns(
        {
            "_mh": F.when((col("_h") > 0) & known, col("_h")).otherwise(0),
            "_m1": F.least("cmargin_1", ceiling),
            "_m2": F.least("cmargin_2", ceiling),
            "_g_post": F.when(col("_h") == 2, F.least(div("_c2", "_c1") - 1.0, F.lit(0.40)))
            .when(col("_h") == 1, F.least(div("_c1", "revenue") - 1.0, F.lit(0.40)))
            .otherwise(col("g_start")),
        }
    ).withColumn("_m_last", F.when(col("_mh") == 2, col("_m2")).when(col("_mh") == 1, col("_m1")).otherwise(col("operating_margin")))
    out = out.withColumn("_m_target", col("_m_last") + col("margin_shift"))

    year = "struct<year: int, revenue: double, growth: double, margin: double, nopat: double, reinvestment: double, fcf: double, pv: double>"
    start = F.struct(col("revenue").cast("double").alias("revenue"), F.array().cast(f"array<{year}>").alias("years"))

    def step(acc: Column, t: Column) -> Column:
        h, mh = col("_h"), col("_mh")
        growth = (
            F.when((t == 1) & (h >= 1), div("_c1", acc["revenue"]) - 1.0)
            .when((t == 2) & (h == 2), div("_c2", acc["revenue"]) - 1.0)
            .otherwise(_fade(col("_g_post"), col("g_end"), t - h, F.lit(YEARS) - h, col("fade_strength")))
        )
        margin = (
            F.when((t == 1) & (mh >= 1), col("_m1"))
            .when((t == 2) & (mh == 2), col("_m2"))
            .otherwise(_fade(col("_m_last"), col("_m_target"), t - mh, F.lit(5), F.lit(1.0)))
        )
        revenue = acc["revenue"] * (1.0 + growth)
        nopat = revenue * margin * (1.0 - col("tax"))
        spent = div(F.greatest(revenue - acc["revenue"], F.lit(0.0)), "s2c")
        fcf = nopat - spent
        this = F.struct(
            t.cast("int").alias("year"), revenue.alias("revenue"), growth.alias("growth"), margin.alias("margin"), nopat.alias("nopat"),
            spent.alias("reinvestment"), fcf.alias("fcf"), div(fcf, F.pow(1.0 + col("rate"), t)).alias("pv"),
        )
        return F.struct(revenue.alias("revenue"), F.concat(acc["years"], F.array(this.cast(year))).alias("years"))

    years = F.aggregate(F.sequence(F.lit(1), F.lit(YEARS)), start, step)["years"]
    out = out.withColumn("years", years)
    final = F.element_at("years", YEARS)
    pv = F.aggregate("years", F.lit(0.0), lambda a, y: a + y["pv"])
    t_roic = F.when(finite("roic") > col("rate"), F.least(finite("roic"), col("rate") + 0.05)).otherwise(col("rate") + 0.01)
    kept = 1.0 - clip(div("g_end", t_roic), 0.0, 0.90)
    terminal = div(final["nopat"] * (1.0 + col("g_end")) * kept, col("rate") - col("g_end"))
    out = out.withColumns({"pv_explicit": pv, "terminal_pv": div(terminal, F.pow(1.0 + col("rate"), YEARS))})
    out = out.withColumn("enterprise_value_dcf", col("pv_explicit") + col("terminal_pv"))
    owed = zero_if_null("net_debt") + zero_if_null("minority_interest") + zero_if_null("preferred_equity")
    first = F.element_at("years", 1)["fcf"]
    swing = div(col("reported_free_cash_flow") - first, "revenue")
    contradicts = (col("reported_free_cash_flow") > 0) & (first < 0) & (swing > FCF_CONTRADICTION)
    return out.withColumns(
        {
            "value_per_share": div(col("enterprise_value_dcf") - owed, "shares"),
            "terminal_share": F.when(col("enterprise_value_dcf") > TINY, div("terminal_pv", "enterprise_value_dcf")),
            "contradicts_fcf": F.coalesce(contradicts, F.lit(False)),
            "ev_negative": col("enterprise_value_dcf") <= 0,
        }
    ).drop("_h", "_c1", "_c2", "_mh", "_m1", "_m2", "_g_post", "_m_last", "_m_target")


def run_scenarios(df: DataFrame) -> DataFrame:
    return project(with_scenarios(df))


def sensitivity(df: DataFrame, ids: list[str]) -> DataFrame:
    """Base value under one changed assumption at a time, widest swing first per company.

    Companies anchored to consensus revenue move the path by 3 %, the others their starting growth by three points.
    """
    anchored = F.coalesce(F.col("level_1").isNotNull() & (F.col("n_revenue_analysts") >= MIN_REVENUE_ANALYSTS), F.lit(False)) if "level_1" in df.columns else F.lit(False)
    tests = [
        ("base", "mid", 0.0, 0.0, 0.0, 1.0),
        ("Revenue growth", "low", -0.03, 0.0, 0.0, 1.0),
        ("Revenue growth", "high", 0.03, 0.0, 0.0, 1.0),
        ("Operating margin", "low", 0.0, -0.02, 0.0, 1.0),
        ("Operating margin", "high", 0.0, 0.02, 0.0, 1.0),
        ("Discount rate", "low", 0.0, 0.0, 0.01, 1.0),
        ("Discount rate", "high", 0.0, 0.0, -0.01, 1.0),
        ("Reinvestment intensity", "low", 0.0, 0.0, 0.0, 0.75),
        ("Reinvestment intensity", "high", 0.0, 0.0, 0.0, 1.25),
    ]
    names = ("assumption", "end", "d_growth", "d_margin", "d_rate", "f_capital")
    cells = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, x)]) for x in tests])
    out = df.withColumn("_t", F.explode(cells)).select("*", "_t.*").drop("_t")
    moved = {
        "growth_rate": zero_if_null("growth_rate") + F.col("d_growth"),
        "operating_margin": F.col("operating_margin") + F.col("d_margin"),
        "risk_free_rate": F.coalesce("risk_free_rate", F.lit(RISK_FREE)) + F.col("d_rate") if "risk_free_rate" in df.columns else F.lit(RISK_FREE) + F.col("d_rate"),
        "sales_to_capital": F.coalesce("sales_to_capital", F.lit(CAPITAL_DEFAULT)) * F.col("f_capital"),
    }
    if "level_1" in df.columns:
        factor = F.when(anchored, 1.0 + F.col("d_growth")).otherwise(1.0)
        moved |= {f"level_{i}": F.col(f"level_{i}") * factor for i in (1, 2)}
        moved |= {f"cmargin_{i}": F.col(f"cmargin_{i}") + F.col("d_margin") for i in (1, 2)}
    base = dict(zip(("growth_multiple", "margin_shift", "fade_strength", "terminal_shift", "rate_shift", "side"), SCENARIOS[1][1:]))
    out = project(out.withColumns(moved).withColumns({k: F.lit(v) for k, v in base.items()}))
    pick = lambda side: F.max(F.when(F.col("end") == side, F.col("value_per_share")))
    ends = out.where(F.col("assumption") != "base").groupBy(*ids, "assumption").agg(pick("low").alias("low_value"), pick("high").alias("high_value"))
    centre = out.where(F.col("assumption") == "base").select(*ids, F.col("value_per_share").alias("base_value"))
    swing = F.when(F.abs("base_value") > TINY, div(F.abs(F.col("high_value") - F.col("low_value")), F.abs("base_value")))
    return ends.join(centre, ids).withColumn("swing_pct", swing)


# ---- peers


def _position(m: Column, trim: float, quantiles: dict[str, float]) -> dict[str, Column]:
    """Positions in ``m`` sorted values: the ends of what the trim leaves, and the neighbours of each quantile."""
    cut = F.lit(trim > 0) & (m >= 5)
    pos = lambda q: (m - 1) * F.lit(float(q))
    out = {"lo": F.when(cut, F.ceil(pos(trim))).otherwise(F.lit(0)), "hi": F.when(cut, F.floor(pos(1.0 - trim))).otherwise(m - 1)}
    for name, q in quantiles.items():
        out |= {f"{name}_a": F.floor(pos(q)), f"{name}_b": F.ceil(pos(q))}
    return out


# Where the kept part begins and stops without a row: the end taken, and whether the row itself lies before it. The row's value is null,
# above the upper end, inside, below the lower end, or tied with it.
_CASES = {
    "none": ("lo_x", 0, "hi_x", 0),
    "above": ("lo_0", 0, "hi_0", 0),
    "inner": ("lo_0", 0, "hi_1", 1),
    "below": ("lo_1", 1, "hi_1", 1),
    "tied": ("lo_1", 0, "hi_1", 1),
}


def leave_one_out_groups(
    members: DataFrame, keys: list[str], value: str, trim: float, quantiles: dict[str, float] | None = None, split: bool = True
) -> DataFrame:
    """One row per group of ``members`` with the few order statistics that ``leave_one_out`` needs, whichever row is left out.

    A group of n values without a row is one of n values (the row's own is null) or of n - 1, whose position k is the group's k or,
    from the row's own place on, k + 1. The ends of the trimmed part follow from n; they bound the median's positions, and only the
    place of the row's value (see ``_CASES``) decides between them. Written, as its few rows are joined to all rows of the groups.
    """
    quantiles = quantiles or {}
    values = members.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    if split:
        steps = ladder(values, keys, "_v")
    else:
        steps = annotate(values, keys, "_v", split=False).distinct()
    steps = cut_lineage(steps)  # read for the ends, then for the medians
    n, v = F.col("n_group"), F.col("_v")
    asked = {f"{name}_x": k for name, k in _position(n, trim, quantiles).items()}
    for name, k in _position(n - 1, trim, quantiles).items():
        asked |= {f"{name}_0": k, f"{name}_1": k + 1}
    found = [F.max(F.when(holds(k), v)).alias(name) for name, k in asked.items()]
    for name, k in asked.items():
        if name.startswith(("lo_", "hi_")):
            found += [F.max(F.when(holds(k), x)).alias(f"{name}_{to}") for to, x in (("from", F.col("n_below")), ("upto", F.col("n_below") + F.col("n_eq")))]
    sums = [F.sum(v * F.col("n_eq")).alias("_s"), F.sum(v * v * F.col("n_eq")).alias("_ss")]
    ends = steps.groupBy(*keys).agg(F.max(n).alias("_n"), *sums, *found)
    middle = {}
    for case, (start, d, stop, e) in _CASES.items():
        start, stop = F.col(f"{start}_from") - d, F.col(f"{stop}_upto") - e
        kept = stop - start
        middle |= {f"{case}_a": start + F.floor((kept - 1) / 2), f"{case}_b": start + F.floor(kept / 2)}
    ends = cut_lineage(ends.withColumns({f"_k_{name}": k for name, k in middle.items()}))
    places = {f"{name}_{d}": F.col(f"_k_{name}") + d for name in middle for d in (0, 1)}
    hits = steps.join(ends.select(*keys, *[f"_k_{name}" for name in middle]), keys).where(reduce(or_, [holds(k) for k in places.values()]))
    medians = hits.groupBy(*keys).agg(*[F.max(F.when(holds(k), v)).alias(name) for name, k in places.items()])
    helpers = [f"_k_{name}" for name in middle] + [f"{x}_{t}_{to}" for x in ("lo", "hi") for t in "x01" for to in ("from", "upto")]
    return cut_lineage(ends.drop(*helpers).join(medians, keys))


def leave_one_out(
    df: DataFrame, keys: list[str], value: str, trim: float, quantiles: dict[str, float] | None = None, split: bool = True, groups: DataFrame | None = None
) -> DataFrame:
    """Trimmed median, linear quantiles, deviation and size of each row's group without the row itself.

    With at least five values, those outside the linear ``trim`` (below a half) and ``1 - trim`` quantiles are dropped before the median.
    A row whose own value is null leaves its group untouched; one with a null key has no group. Adds ``loo_n, loo_median, loo_std`` and
    the named quantiles. ``groups`` are the ``leave_one_out_groups`` when ``df`` is only a part of their members.
    """
    quantiles = quantiles or {}
    if groups is None:
        groups = leave_one_out_groups(df, keys, value, trim, quantiles, split)
    out = df.join(groups.withColumn("_g", F.struct(*[x for x in groups.columns if x not in keys])).select(*keys, "_g"), keys, "left")
    own, g = F.col(value).cast("double"), lambda name: F.col(f"_g.{name}")
    known = own.isNotNull()
    n = F.coalesce(g("_n"), F.lit(0))
    out = out.withColumn("loo_n", F.when(n > 0, n - known.cast("long")).otherwise(F.lit(0)))
    m = F.col("loo_n")
    without = lambda name: F.when(g(f"{name}_0") < own, g(f"{name}_0")).otherwise(g(f"{name}_1"))
    centre = lambda case: (without(f"{case}_a") + without(f"{case}_b")) / 2.0
    median = (
        F.when(~known, (g("none_a_0") + g("none_b_0")) / 2.0).when(g("hi_0") < own, centre("above")).when(g("lo_0") < own, centre("inner"))
        .when(own < g("lo_1"), centre("below")).otherwise(centre("tied"))
    )
    mean = div(g("_s") - F.coalesce(own, F.lit(0.0)), m)
    var = div(g("_ss") - F.coalesce(own * own, F.lit(0.0)), m) - mean * mean
    named = {"loo_median": F.when(m > 0, median), "loo_std": F.when(m > 0, F.sqrt(F.greatest(var, F.lit(0.0))))}
    for name, q in quantiles.items():
        pos = (m - 1) * F.lit(float(q))
        a, b = (F.when(known, without(f"{name}_{s}")).otherwise(g(f"{name}_{s}_x")) for s in "ab")
        named[name] = F.when(m > 0, a + (b - a) * (pos - F.floor(pos)))
    return out.withColumns(named).drop("_g")


def choose_peer_group(df: DataFrame, min_peers: int = MIN_PEERS) -> DataFrame:
    """Industry when it holds enough other companies on the date, otherwise the sector: ``peer_kind, peer_group``.

    The sizes are written: one row per date and industry, which Spark would otherwise take for as large as the panel.
    """
    sizes = cut_lineage(df.groupBy("date", "industry").agg(F.count(F.lit(1)).alias("_n")))
    out = df.join(sizes, ["date", "industry"], "left")
    narrow = F.coalesce(F.col("_n") - 1 >= min_peers, F.lit(False))
    return out.withColumn("peer_kind", F.when(narrow, "industry").otherwise("sector")).drop("_n")


def _chosen() -> Column:
    return F.when(F.col("peer_kind") == "industry", F.col("industry")).otherwise(F.col("sector"))


def _cells(columns: list[str], positive: bool) -> Column:
    """One entry per column: its name and its usable value."""
    value = lambda x: F.when(F.col(x) > 0, finite(x)) if positive else finite(x)
    return F.array(*[F.struct(F.lit(x).alias("multiple"), value(x).alias("x")) for x in columns])


def peer_groups(df: DataFrame, columns: list[str], trim: float, quantiles: dict[str, float] | None = None, positive: bool = True) -> DataFrame:
    """``leave_one_out_groups`` of several columns for every group that some row chose, by ``date, kind, grp, multiple``.

    All members of such a group count, also those that chose the other kind themselves. Their values travel with the number of the group
    and column instead of its names.
    """
    size = len(columns)
    asked = df.select("date", F.col("peer_kind").alias("kind"), _chosen().alias("grp")).distinct().where("grp is not null")
    asked = cut_lineage(asked.withColumn("_no", F.monotonically_increasing_id() * size))  # one row per date and group
    both = F.array(*[F.struct(F.lit(x).alias("kind"), F.col(x).alias("grp")) for x in ("industry", "sector")])
    rows = df.withColumn("_g", F.explode(both)).select("date", "_g.*", *columns).join(asked, ["date", "kind", "grp"])
    long = rows.select("_no", F.posexplode(_cells(columns, positive)).alias("_i", "_c")).select((F.col("_no") + F.col("_i")).alias("_no"), "_c.x")
    found = leave_one_out_groups(long, ["_no"], "x", trim, quantiles)
    names = F.posexplode(F.array(*[F.lit(x) for x in columns])).alias("_i", "multiple")
    named = asked.select("date", "kind", "grp", "_no", names).withColumn("_no", F.col("_no") + F.col("_i")).drop("_i")
    return cut_lineage(named.join(found, "_no").drop("_no"))


def peer_statistics(
    df: DataFrame, columns: list[str], trim: float, quantiles: dict[str, float] | None = None, positive: bool = True,
    carried: tuple[str, ...] = (), groups: DataFrame | None = None,
) -> DataFrame:
    """Leave-one-out statistics of several columns over each row's chosen peer group, long: one row per company and column.

    Rows keep the columns named in ``carried``; ``groups`` are the ``peer_groups`` if the caller has them.
    """
    if groups is None:
        groups = peer_groups(df, columns, trim, quantiles, positive)
    kept = ("company_id", "date", *carried)
    long = df.select(*kept, F.col("peer_kind").alias("kind"), _chosen().alias("grp"), F.explode(_cells(columns, positive)).alias("_c")).select(*kept, "kind", "grp", "_c.*")
    return leave_one_out(long, ["date", "kind", "grp", "multiple"], "x", trim, quantiles, groups=groups)


def quality_adjustment(df: DataFrame, cap: float = MAX_ADJUSTMENT) -> DataFrame:
    """Premium for growing faster or earning wider margins than the peer group, at most ``cap`` either way.

    The groups' statistics come to the rows, which stay as they are: no row is moved.
    """
    groups = peer_groups(df, ["growth", "margin"], 0.0, positive=False)
    groups = groups.withColumnsRenamed({"kind": "_kind", "grp": "_grp"})
    out, total = df.withColumns({"_kind": F.col("peer_kind"), "_grp": _chosen()}), F.lit(0.0)
    for name, weight, floor in (("growth", 0.10, 0.05), ("margin", 0.08, 0.03)):
        out = out.withColumn("_x", finite(name))
        out = leave_one_out(out, ["date", "_kind", "_grp"], "_x", 0.0, groups=groups.where(F.col("multiple") == name).drop("multiple"))
        spread = F.greatest(F.when(F.col("loo_std") > 1e-9, F.col("loo_std")).otherwise(floor), F.lit(0.01))
        z = clip(div(F.col("_x") - F.col("loo_median"), spread), -2.0, 2.0)
        out = out.withColumn(f"_{name}", F.when((F.col("loo_n") >= 5) & F.col("_x").isNotNull(), z * weight).otherwise(0.0))
        total = total + F.col(f"_{name}")
    out = out.withColumn("adjustment", clip(total, -cap, cap))
    return out.select(*[x for x in df.columns if x != "adjustment"], "adjustment")


def equity_from_multiple(multiple: Column, key: str = "multiple") -> Column:
    """Equity value a multiple implies for the row's own driver; enterprise multiples give up the claims ahead of equity."""
    k = F.col(key)
    claims = zero_if_null("net_debt") + zero_if_null("minority_interest") + zero_if_null("preferred_equity")
    out = F.when((k == "fcf_yield") & (multiple > TINY) & (F.col("free_cash_flow") > 0), div("free_cash_flow", multiple))
    for name, driver in ENTERPRISE.items():
        out = out.when((k == name) & (F.col(driver) > 0), multiple * F.col(driver) - claims)
    for name, driver in EQUITY_LEVEL.items():
        out = out.when((k == name) & (F.col(driver) > 0), multiple * F.col(driver))
    return out


def comparables(df: DataFrame, min_peers: int = MIN_PEERS) -> DataFrame:
    """Value per share from every usable peer multiple of the business model, blended by their median.

    Values more than four times away from the median are dropped; the range is that of the kept ones, or the peers' own 25-75 %
    span when only one is left. A company has at most seven multiples, so its short list is handled inside the row.
    """
    keys = list(dict.fromkeys([*ENTERPRISE, "fcf_yield", *EQUITY_LEVEL]))
    used = [k for k in keys if k in df.columns]
    drivers = ("ebit", "ebitda", "revenue", "free_cash_flow", "forward_earnings", "net_income", "equity", "net_debt", "minority_interest", "preferred_equity")
    needed = dict.fromkeys(["company_id", "date", "industry", "sector", "business_model", "shares", "growth", "margin", *used, *drivers])
    # Only what is used below is written; it is read for the sizes, for the members of both rounds of groups and for the result.
    narrow = cut_lineage(df.select(*[F.col(x) if x in df.columns or x not in drivers else F.lit(None).cast("double").alias(x) for x in needed]))
    subject = choose_peer_group(narrow, min_peers)
    spans = {"q_low": 0.25, "q_high": 0.75}
    groups = peer_groups(subject, used, PEER_TRIM, spans)
    carried = ("business_model", "shares", "adjustment", *drivers)
    rows = peer_statistics(quality_adjustment(subject, MAX_ADJUSTMENT), used, PEER_TRIM, spans, carried=carried, groups=groups)
    wanted = F.when(F.lit(False), F.lit(False))
    for model, order in MULTIPLES_FOR.items():
        wanted = wanted.when(F.col("business_model") == model, F.col("multiple").isin(list(order)))
    rows = rows.where(wanted.otherwise(F.col("multiple").isin(list(DEFAULT_MULTIPLES)))).where(F.col("loo_n") >= min_peers)
    grow = 1.0 + F.coalesce("adjustment", F.lit(0.0))
    adjusted = lambda x: F.when(F.col("multiple") == "fcf_yield", div(x, grow)).otherwise(F.col(x) * grow)
    share = lambda x: div(equity_from_multiple(adjusted(x)), "shares")
    rows = rows.withColumns({"value": share("loo_median"), "e1": share("q_low"), "e2": share("q_high")}).where((F.col("value") > 0) & (F.col("shares") > 0))
    item = F.struct("value", "multiple", F.least("e1", "e2").alias("low"), F.greatest("e1", "e2").alias("high"))
    per = rows.groupBy("company_id", "date").agg(F.sort_array(F.collect_list(item)).alias("_all"), F.first("adjustment").alias("adjustment"))
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int"))["value"] + F.get(a, F.floor(F.size(a) / 2).cast("int"))["value"]) / 2.0
    per = per.withColumn("_mid", middle(F.col("_all")))
    near = F.filter("_all", lambda x: (x["value"] >= F.col("_mid") / MAX_MULTIPLE_RATIO) & (x["value"] <= F.col("_mid") * MAX_MULTIPLE_RATIO))
    per = per.withColumn("_kept", F.when(F.size(near) > 0, near).otherwise(F.col("_all")))
    kept, one = F.col("_kept"), F.size("_kept") == 1
    return per.select(
        "company_id",
        "date",
        middle(kept).alias("value_per_share"),
        F.when(one, F.get(kept, F.lit(0))["low"]).otherwise(F.get(kept, F.lit(0))["value"]).alias("value_low"),
        F.when(one, F.get(kept, F.lit(0))["high"]).otherwise(F.get(kept, F.size(kept) - 1)["value"]).alias("value_high"),
        "adjustment",
        F.size("_kept").alias("n_multiples"),
    )


# ---- own history and sector models


def own_history(panel: DataFrame, columns: list[str], trim: float = HISTORY_TRIM, min_observations: int = 500) -> DataFrame:
    """Trimmed median of each company's own positive multiples (one value per date of one company: bounded by the calendar)."""
    cells = F.array(*[F.struct(F.lit(x).alias("multiple"), F.when(F.col(x) > 0, finite(x)).alias("x")) for x in columns])
    long = panel.select("company_id", F.explode(cells).alias("_c")).select("company_id", "_c.*").where("x is not null")
    edges = long.groupBy("company_id", "multiple").agg(
        F.count("x").alias("observations"), F.percentile("x", F.lit(trim)).alias("_lo"), F.percentile("x", F.lit(1.0 - trim)).alias("_hi")
    )
    cut = F.col("observations") >= 5
    inner = long.join(edges, ["company_id", "multiple"]).where(~cut | F.col("x").between(F.col("_lo"), F.col("_hi")))
    mid = inner.groupBy("company_id", "multiple", "observations").agg(F.median("x").alias("typical"))
    return mid.where(F.col("observations") >= min_observations)


def historical(subjects: DataFrame, typical: DataFrame, order: tuple[str, ...] = HISTORY_ORDER) -> DataFrame:
    """Value at the company's own typical multiple, the first usable one in order of preference; flags a changed business."""
    rows = subjects.join(typical, "company_id")
    place = mapped("multiple", {k: i for i, k in enumerate(order)})
    rows = rows.withColumns({"_place": place, "_value": div(equity_from_multiple(F.col("typical")), "shares")})
    rows = rows.where(F.col("_place").isNotNull() & F.col("_value").isNotNull())
    best = rows.groupBy("company_id").agg(F.min_by(F.struct("multiple", "typical", "observations", F.col("_value").alias("value_per_share")), "_place").alias("_b"))
    return best.select("company_id", "_b.*")


def regime_change(growth_delta: float = 0.15, margin_delta: float = 0.08) -> Column:
    moved = lambda a, b, d: F.coalesce(F.abs(F.col(a) - F.col(b)) > d, F.lit(False))
    return moved("revenue_growth", "historical_growth", growth_delta) | moved("operating_margin", "historical_margin", margin_delta)


def own_medians(panel: DataFrame) -> DataFrame:
    """Per company: median margin and growth over its own dates, and how many margins there are."""
    return panel.groupBy("company_id").agg(
        F.median("operating_margin").alias("historical_margin"), F.median("revenue_growth_1y").alias("historical_growth"), F.count("operating_margin").alias("n_margins")
    )


def residual_income(equity, roe, coe, shares, growth: float = 0.02, years: int = 10) -> Column:
    """Book value plus the present value of returns above the cost of equity, the excess fading to nothing over ten years."""
    r = clip(roe, -0.30, 0.40)
    terms = [
        div(F.pow(F.lit(1.0 + growth), t - 1) * (r - coe) * (1.0 - (t - 1) / years), F.pow(1.0 + coe, t)) for t in range(1, years + 1)
    ]
    return F.when((equity > 0) & (shares > 0) & r.isNotNull(), div(equity * (1.0 + reduce(add, terms)), shares))


def bank_value(coe: Column) -> Column:
    book, soft = F.col("equity"), F.col("intangibles")
    tangible = F.when(F.coalesce(soft, F.lit(0.0)) != 0, F.greatest(book - soft, book * 0.2)).otherwise(book)
    return residual_income(F.when(book > 0, tangible), finite("roe"), coe, F.col("shares"))


def insurer_value(coe: Column) -> Column:
    """Residual income on a return reduced by half the underwriting loss (at most five points)."""
    loss = div("policy_benefits", F.when(F.col("premiums_earned") > TINY, F.col("premiums_earned")))
    penalty = F.when(loss > 1.0, F.least((loss - 1.0) * 0.5, F.lit(0.05))).otherwise(0.0)
    roe = F.when(loss > 1.0, zero_if_null("roe") - penalty).otherwise(finite("roe"))
    return residual_income(F.col("equity"), roe, coe, F.col("shares"), growth=0.03)


def reit_value(multiple: float = 18.0, cap_rate: float = 0.055) -> Column:
    """60 % adjusted funds from operations at a multiple, 40 % net asset value at a capitalisation rate."""
    ffo = F.col("net_income") + F.col("depreciation")
    affo = ffo - F.coalesce("capex", F.col("depreciation") * 0.15)
    nav = ffo / cap_rate - F.col("net_debt")
    equity = F.when(nav > 0, 0.6 * affo * multiple + 0.4 * nav).otherwise(affo * multiple)
    return F.when((F.col("shares") > 0) & (affo > 0), div(equity, "shares"))


def normalised_value(multiple: float = 12.0, min_margins: int = 8) -> Column:
    """Revenue at the mid-cycle margin, capitalised; the current margin stands in for a short history."""
    margin = F.coalesce(F.when(F.col("n_margins") >= min_margins, F.col("historical_margin")), finite("operating_margin"))
    ebit = F.col("revenue") * margin
    return F.when((F.col("shares") > 0) & (F.col("revenue") > 0) & (ebit > 0), div(ebit * multiple - zero_if_null("net_debt"), "shares"))


# ---- blend


def method_weight(model: str = "business_model", method: str = "method") -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for m, weights in METHOD_WEIGHTS.items():
        for k, w in weights.items():
            out = out.when((F.col(model) == m) & (F.col(method) == k), w)
    return out


def blend(methods: DataFrame, companies: DataFrame) -> DataFrame:
    """Weighted value over the methods that apply and are plausible, their dispersion, and the fair-value range.

    ``methods``: company_id, method, value, low, high, usable, halve. ``companies``: company_id, business_model, price and the
    three DCF scenario values ``dcf_bear, dcf_base, dcf_bull`` (null when the DCF was not usable).
    """
    rows = methods.join(companies.select("company_id", "business_model", "price"), "company_id")
    ratio = div("value", F.when(F.col("price") > TINY, F.col("price")))
    plausible = F.col("price").isNull() | (F.col("price") <= TINY) | ratio.between(0.05, 10.0)
    rows = rows.withColumn("weight", method_weight() * F.when(F.coalesce("halve", F.lit(False)), 0.5).otherwise(1.0))
    rows = rows.where(F.col("weight").isNotNull() & F.col("usable") & F.col("value").isNotNull() & plausible)
    agg = rows.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("n_methods"),
        (F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("base"),
        F.stddev_pop("value").alias("_std"),
        F.min("value").alias("_min"),
        F.max("value").alias("_max"),
        F.max(F.col("method") == "dcf").alias("dcf_used"),
        F.max_by("method", "method").alias("_lone"),
        F.max("low").alias("_low"),
        F.max("high").alias("_high"),
    )
    out = companies.join(agg, "company_id", "left")
    many = F.col("n_methods") > 1
    out = out.withColumn("dispersion", F.when(many & (F.abs("base") > TINY), div("_std", F.abs("base"))))
    lo, hi = div("dcf_bear", "dcf_base"), div("dcf_bull", "dcf_base")
    sane = F.col("dcf_used") & lo.between(0.2, 1.0) & hi.between(1.0, 3.0)
    alone = (F.col("n_methods") == 1) & (F.col("_low") < F.col("_high"))
    band = F.least(F.greatest(F.coalesce("dispersion", F.lit(0.0)), F.when(many, 0.20).otherwise(0.35)), F.lit(0.60))
    base = F.col("base")
    bear = F.when(sane, base * lo).when(alone, F.col("_low")).otherwise(base * (1.0 - band))
    bull = F.when(sane, base * hi).when(alone, F.col("_high")).otherwise(base * (1.0 + band))
    out = out.withColumns({"bear": bear, "bull": bull})
    low_end = F.when(many, F.least("bear", "bull", "_min", "base")).otherwise(F.least("bear", "bull", "base"))
    high_end = F.when(many, F.greatest("bear", "bull", "_max", "base")).otherwise(F.greatest("bear", "bull", "base"))
    out = out.withColumns({"_b": low_end, "_t": high_end})
    out = out.withColumns(
        {
            "bear": F.when(base.isNotNull(), F.col("_b")),
            "bull": F.when(base.isNotNull(), F.col("_t")),
            "upside": div("base", F.when(F.col("price") > TINY, F.col("price"))) - 1.0,
            "generic_band": base.isNotNull() & ~F.coalesce(sane, F.lit(False)) & ~F.coalesce(alone, F.lit(False)),
        }
    )
    return out.drop("_std", "_min", "_max", "_lone", "_low", "_high", "_b", "_t")


def valuation_confidence() -> Column:
    """Product of penalties: few or disagreeing methods, a wide range, one dominant assumption, a heavy terminal value, thin or old data."""
    width = div(F.col("bull") - F.col("bear"), F.abs("base"))
    d, swing, term = F.col("dispersion"), F.col("worst_swing"), F.col("terminal_share")
    dcf = F.coalesce(F.col("has_dcf"), F.lit(False))
    cov, age, n = F.col("metric_coverage"), F.col("data_age_days"), F.col("n_analysts")
    pick = lambda *pairs: reduce(lambda acc, p: acc.when(F.coalesce(p[0], F.lit(False)), p[1]), pairs[1:], F.when(F.coalesce(pairs[0][0], F.lit(False)), pairs[0][1])).otherwise(1.0)
    factors = [
        pick((F.col("n_methods") == 1, 0.70), (d.isNull(), 0.70), (d > 0.50, 0.55), (d > 0.25, 0.80)),
        pick((width > 1.5, 0.50), (width > 1.0, 0.70), (width > 0.7, 0.88)),
        pick((swing > 1.0, 0.60), (swing > 0.50, 0.80)),
        pick((dcf & term.isNull(), 0.60), (dcf & (term > 0.85), 0.70), (dcf & (term > 0.80), 0.88)),
        pick((cov < 0.5, 0.65), (cov < 0.75, 0.85)),
        pick((age > 130, 0.80)),
        pick((n < 5, 0.90)),
        pick((F.col("business_model") == "unprofitable_growth", 0.65), (F.col("business_model") == "cyclical", 0.85)),
    ]
    return F.when(F.col("base").isNull(), 0.0).otherwise(clip(reduce(mul, factors), 0.0, 1.0))


def valuation_caveats() -> Column:
    """Ordered, de-duplicated reasons for doubt."""
    flags = [
        (F.col("base").isNull(), "no valuation method could run"),
        (F.col("n_methods") == 1, "only one method"),
        (F.col("dispersion") > 0.25, "methods disagree"),
        (F.col("generic_band"), "generic range"),
        (F.col("data_age_days") > 130, "old financials"),
        (F.col("business_model") == "cyclical", "cyclical earnings"),
        (F.col("business_model") == "unprofitable_growth", "not yet profitable"),
    ]
    listed = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(text)) for c, text in flags])
    return F.array_distinct(F.filter(listed, lambda x: x.isNotNull()))


def classify(price="price", base="base", low="bear", high="bull", confidence="confidence") -> Column:
    """Where the price sits against the fair value; thresholds widen with the range, and doubt declines to answer."""
    p, b = F.col(price), F.col(base)
    width = clip(div(div(F.col(high) - F.col(low), F.abs(b)), REFERENCE_WIDTH), 0.5, MAX_WIDTH)
    width = F.coalesce(width, F.lit(1.0))
    upside = div(b, F.when(p > TINY, p)) - 1.0
    s2, s1, o1, o2 = CLASS_STEPS
    return (
        F.when(upside.isNull() | (F.col(confidence) < MIN_CONFIDENCE), "insufficient_confidence")
        .when(upside >= s2 * width, "significantly_undervalued")
        .when(upside >= s1 * width, "undervalued")
        .when(upside <= o2 * width, "significantly_overvalued")
        .when(upside <= o1 * width, "overvalued")
        .otherwise("fairly_valued")
    )
