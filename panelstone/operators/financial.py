"""Fundamental metrics on an as-of panel: building blocks, quality, growth and valuation ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstone.functions.numeric import TINY, bounded, cagr, clip, either, safe_div, zero_if_null
from panelstone.operators.asof import asof_backward, attach_wide, lag_asof
from panelstone.operators.rolling import day_rolling

# Concepts the panel carries.
CONCEPTS = (
    "revenue cost_of_revenue gross_profit operating_income pretax_income tax_expense net_income net_income_to_common "
    "interest_expense depreciation_amortization depreciation_only amortization_intangibles share_based_comp eps_diluted "
    "eps_basic shares_diluted shares_basic rnd sga operating_expenses operating_cash_flow capex acquisitions buyback "
    "dividends_paid stock_issued debt_issued debt_repaid assets current_assets liabilities current_liabilities equity "
    "equity_incl_nci minority_interest preferred_equity cash short_term_investments debt_long debt_current "
    "operating_lease_liability inventory receivables payables ppe_net goodwill intangibles retained_earnings "
    "shares_outstanding interest_income net_interest_income noninterest_income noninterest_expense credit_provision loans "
    "deposits premiums_earned policy_benefits"
).split()
# Effective tax range, the rate when unknown, and how stale a tagged gross profit may be.
TAX_FLOOR, TAX_CAP, TAX_DEFAULT = 0.10, 0.35, 0.21
MAX_CONCEPT_LAG_DAYS = 120
HISTORY_DAYS = 1825
LAG_YEARS = (1, 3, 5)
LAGGED = (
    "revenue eps_diluted free_cash_flow gross_profit shares_current_basis operating_margin net_income assets total_debt "
    "current_ratio gross_margin roic"
).split()


def build_grid(prices: DataFrame, securities: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Company-date rows for primary share classes only, optionally on given dates."""
    primary = securities.where("is_primary").select("company_id", "ticker")
    grid = prices.join(primary, "ticker")
    if dates is not None:
        grid = grid.join(F.broadcast(dates), "date", "left_semi")  # one row per session
    return grid.select("company_id", "ticker", "date", "close_raw", "close_adj", "split_factor")


def attach_fundamentals(grid: DataFrame, fundamentals: DataFrame, concepts: list[str] | None = None) -> DataFrame:
    return attach_wide(grid, fundamentals, list(concepts or CONCEPTS))


def attach_share_basis(panel: DataFrame, prices: DataFrame) -> DataFrame:
    """Split factor in force when the share count became available; earliest known factor, then 1, as fallbacks."""
    asof = F.coalesce("shares_diluted__asof", "shares_outstanding__asof")
    out = asof_backward(
        panel.withColumn("_shares_at", asof),
        prices.select("ticker", "date", "split_factor"),
        ["ticker"],
        "_shares_at",
        "date",
        {"split_factor": "_basis"},
    )
    first = prices.groupBy("ticker").agg(F.min_by("split_factor", "date").alias("_first"))
    return (
        out.join(first, "ticker", "left")
        .withColumn("shares_split_factor", F.coalesce("_basis", "_first", F.lit(1.0)))
        .drop("_basis", "_first", "_shares_at")
    )


def add_building_blocks(panel: DataFrame) -> DataFrame:
    """Quantities several metrics share, in dependency order."""
    col = F.col
    out = panel.withColumn("revenue", either("revenue", col("operating_income") + col("operating_expenses")))
    stale = F.datediff("revenue__asof", "gross_profit__asof") > MAX_CONCEPT_LAG_DAYS
    fresh = ~F.coalesce(stale, F.lit(False))
    out = out.withColumns(
        {
            "gross_profit": either(
                F.when(fresh, col("gross_profit")), col("revenue") - col("cost_of_revenue"), "gross_profit"
            ),
            "total_debt": zero_if_null("debt_long") + zero_if_null("debt_current"),
            "cash_and_equivalents": zero_if_null("cash") + zero_if_null("short_term_investments"),
            "free_cash_flow": col("operating_cash_flow") - col("capex"),
        }
    )
    narrow = F.abs(col("depreciation_amortization") - col("depreciation_only")) < 1.0
    da = col("depreciation_amortization") + F.when(narrow, zero_if_null("amortization_intangibles")).otherwise(0.0)
    own_funds = F.greatest(zero_if_null("equity") + col("total_debt"), F.lit(0.0))
    tax = safe_div("tax_expense", "pretax_income", positive_only=True)
    out = out.withColumns(
        {"depreciation_amortization": da, "cash_usable": F.least("cash_and_equivalents", own_funds)}
    ).withColumns(
        {
            "net_debt": col("total_debt") - col("cash_usable"),
            "ebit": col("operating_income"),
            "ebitda": col("operating_income") + zero_if_null("depreciation_amortization"),
            "free_cash_flow_ex_sbc": col("free_cash_flow") - zero_if_null("share_based_comp"),
            "effective_tax_rate": clip(tax, TAX_FLOOR, TAX_CAP),
            "shares_reported": either("shares_diluted", "shares_outstanding", "shares_basic"),
        }
    )
    out = out.withColumn("shares_current_basis", col("shares_reported") * col("shares_split_factor"))
    earned = either("net_income_to_common", "net_income")
    claims = [zero_if_null(x) for x in ("minority_interest", "preferred_equity", "operating_lease_liability")]
    return out.withColumns(
        {
            "market_cap": col("close_raw") * col("shares_current_basis"),
            "eps_diluted": either(safe_div(earned, "shares_current_basis", positive_only=True), "eps_diluted"),
            "invested_capital": either("equity_incl_nci", "equity") + col("total_debt") - col("cash_and_equivalents"),
            "nopat": col("operating_income") * (1.0 - either("effective_tax_rate", TAX_DEFAULT)),
        }
    ).withColumn(
        "enterprise_value",
        col("market_cap") + col("total_debt") + claims[0] + claims[1] + claims[2] - col("cash_and_equivalents"),
    )


def add_quality(panel: DataFrame, history_days: int = HISTORY_DAYS, min_n: int = 8) -> DataFrame:
    over = lambda num, den: safe_div(num, den, positive_only=True)
    book = either("equity_incl_nci", "equity")
    out = panel.withColumns(
        {
            "roic": over("nopat", "invested_capital"),
            "roe": over("net_income", "equity"),
            "gross_margin": bounded(over("gross_profit", "revenue"), -1.0, 1.0),
            "operating_margin": bounded(over("operating_income", "revenue"), -1.0, 1.0),
            "fcf_margin": bounded(over("free_cash_flow", "revenue"), -1.0, 1.0),
            "fcf_conversion": over("free_cash_flow", "net_income"),
            "interest_coverage": over("operating_income", "interest_expense"),
            "net_debt_to_ebitda": over("net_debt", "ebitda"),
            "current_ratio": over("current_assets", "current_liabilities"),
            "equity_to_assets": over(book, "assets"),
            "accrual_ratio": over(F.col("net_income") - F.col("operating_cash_flow"), "assets"),
        }
    )
    spread = day_rolling("operating_margin", "std", ["company_id"], "date", history_days, min_n)
    return out.withColumn("_spread", spread).withColumn("margin_stability", 1.0 / (1.0 + F.col("_spread") * 10.0)).drop("_spread")


def lagged(panel: DataFrame, columns: list[str], years=LAG_YEARS) -> DataFrame:
    """Values knowable 365 x years days earlier, suffixed ``__lag{n}y``."""
    return lag_asof(panel, ["company_id"], "date", columns, {f"__lag{y}y": 365 * y for y in years})


def add_growth(panel: DataFrame) -> DataFrame:
    out = lagged(panel, [x for x in LAGGED if x in panel.columns])
    col = F.col
    change = lambda x: safe_div(col(x) - col(f"{x}__lag1y"), F.abs(col(f"{x}__lag1y")))
    compound = lambda x, y: cagr(x, f"{x}__lag{y}y", y)
    return out.withColumns(
        {
            "revenue_growth_1y": change("revenue"),
            "revenue_growth_3y": compound("revenue", 3),
            "revenue_growth_5y": compound("revenue", 5),
            "eps_growth_1y": change("eps_diluted"),
            "eps_growth_3y": compound("eps_diluted", 3),
            "fcf_growth_3y": compound("free_cash_flow", 3),
            "gross_profit_growth_3y": compound("gross_profit", 3),
            "share_count_change": change("shares_current_basis"),
            "margin_trend": col("operating_margin") - col("operating_margin__lag1y"),
            "acquisition_intensity": safe_div("acquisitions", "revenue", positive_only=True),
        }
    ).withColumn("growth_acceleration", col("revenue_growth_1y") - col("revenue_growth_3y"))


def add_valuation(panel: DataFrame, history_days: int = HISTORY_DAYS, min_n: int = 20) -> DataFrame:
    col = F.col
    over = lambda num, den: safe_div(num, den, positive_only=True)
    multiple = lambda den: safe_div("enterprise_value", den, positive_only=True, numerator_positive=True)
    paid_out = zero_if_null("dividends_paid") + zero_if_null("buyback") - zero_if_null("stock_issued")
    out = panel.withColumns(
        {
            "ev_ebit": multiple("ebit"),
            "ev_ebitda": multiple("ebitda"),
            "ev_revenue": multiple("revenue"),
            "fcf_yield": over("free_cash_flow", "market_cap"),
            "earnings_yield": over("net_income", "market_cap"),
            "price_to_book": over("market_cap", either("equity_incl_nci", "equity")),
            "sales_yield": over("revenue", "market_cap"),
            "shareholder_yield": over(paid_out, "market_cap"),
            "dividend_yield": over("dividends_paid", "market_cap"),
            "capex_intensity": over("capex", "revenue"),
            "rnd_intensity": over("rnd", "revenue"),
            "trailing_pe": over("close_raw", "eps_diluted"),
        }
    ).withColumn("_multiple", either("ev_ebit", "ev_ebitda", "trailing_pe"))
    stat = lambda kind: day_rolling("_multiple", kind, ["company_id"], "date", history_days, min_n)
    out = out.withColumns({"_mid": stat("median"), "_dev": stat("std")})
    z = F.when(col("_dev") > TINY, (col("_mid") - col("_multiple")) / col("_dev"))
    return out.withColumn("valuation_vs_history", clip(z, -3.0, 3.0)).drop("_multiple", "_mid", "_dev")


def build_financial_metrics(grid: DataFrame, fundamentals: DataFrame, prices: DataFrame, concepts: list[str] | None = None) -> DataFrame:
    """The full fundamental panel for a company-date grid."""
    panel = attach_fundamentals(grid, fundamentals, concepts)
    return (
        attach_share_basis(panel, prices)
        .transform(add_building_blocks)
        .transform(add_quality)
        .transform(add_growth)
        .transform(add_valuation)
    )


def provider_cross_check(panel: DataFrame, provider: str = "provider_shares", factor: float = 5.0) -> DataFrame:
    """Where filing and provider share counts differ more than five times either way, trust the provider; rebuild market cap."""
    ratio = safe_div(provider, "shares_current_basis", positive_only=True)
    apart = F.coalesce((ratio > factor) | (ratio < 1.0 / factor), F.lit(False)) | F.col("shares_current_basis").isNull()
    trusted = apart & F.col(provider).isNotNull()
    return panel.withColumns(
        {"share_source": F.when(trusted, "provider").otherwise("filing"), "shares_current_basis": F.when(trusted, F.col(provider)).otherwise(F.col("shares_current_basis"))}
    ).withColumn("market_cap", F.col("close_raw") * F.col("shares_current_basis"))
