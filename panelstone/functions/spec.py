"""Declared scoring and labelling specification. Everything here is fixed values."""

from __future__ import annotations

from dataclasses import dataclass

BUSINESS_MODELS = ("operating", "bank", "insurer", "reit", "cyclical", "unprofitable_growth")
NON_FINANCIAL = ("operating", "cyclical", "unprofitable_growth")
WINSOR = 0.02
MIN_PEERS = 8
CATEGORY_WEIGHTS = {"quality": 0.30, "growth": 0.25, "momentum": 0.25, "valuation": 0.20}
MIN_CATEGORY_COVERAGE = 0.40
MIN_TOTAL_COVERAGE = 0.50
SPEC_VERSION = "score-2026.09.1"
# Which groupings to try for each peer basis, finest first.
PEER_CHAIN = {
    "industry": ("industry", "sector", "universe"),
    "sector": ("sector", "universe"),
    "size_decile": ("size_decile", "universe"),
    "universe": ("universe",),
}
SCORE_BANDS = [(68.0, "Very attractive"), (60.0, "Attractive"), (42.0, "Neutral"), (33.0, "Unattractive"), (0.0, "Very unattractive")]
NOT_SCORED = "Not scored"


@dataclass(frozen=True)
class Metric:
    key: str
    category: str
    direction: int
    weight: float
    basis: str
    models: tuple[str, ...]
    winsor: float = WINSOR
    min_peers: int = MIN_PEERS


# Metric, category, direction, weight, peer basis, business models it applies to.
_METRICS = """
roic                    quality   +1 0.16 industry non-financial
roe                     quality   +1 0.10 industry all
gross_margin            quality   +1 0.08 industry non-financial
operating_margin        quality   +1 0.10 industry all
fcf_margin              quality   +1 0.10 industry all
margin_stability        quality   +1 0.08 industry all
fcf_conversion          quality   +1 0.08 industry all
accrual_ratio           quality   -1 0.07 industry all
interest_coverage       quality   +1 0.07 industry non-financial
net_debt_to_ebitda      quality   -1 0.08 industry non-financial
share_count_change      quality   -1 0.08 universe all
revenue_growth_1y       growth    +1 0.10 industry all
revenue_growth_3y       growth    +1 0.10 industry all
revenue_growth_5y       growth    +1 0.06 industry all
eps_growth_1y           growth    +1 0.09 industry all
eps_growth_3y           growth    +1 0.09 industry all
fcf_growth_3y           growth    +1 0.08 industry all
gross_profit_growth_3y  growth    +1 0.06 industry non-financial
growth_acceleration     growth    +1 0.08 industry all
eps_revision_3m         growth    +1 0.12 universe all
revenue_revision_3m     growth    +1 0.06 universe all
earnings_surprise       growth    +1 0.08 universe all
forward_eps_growth      growth    +1 0.08 industry all
mom_12_1                momentum  +1 0.18 universe all
mom_6_1                 momentum  +1 0.12 universe all
ret_3m                  momentum  +1 0.08 universe all
rel_strength_spy        momentum  +1 0.12 universe all
rel_strength_sector     momentum  +1 0.10 universe all
px_over_ma200           momentum  +1 0.08 universe all
ma200_slope             momentum  +1 0.08 universe all
momentum_consistency    momentum  +1 0.08 universe all
near_52w_high           momentum  +1 0.08 universe all
post_earnings_drift     momentum  +1 0.08 universe all
ev_ebit                 valuation -1 0.12 industry non-financial
ev_ebitda               valuation -1 0.10 industry non-financial
fcf_yield               valuation +1 0.14 industry all
earnings_yield          valuation +1 0.10 industry all
forward_pe              valuation -1 0.10 industry all
ev_revenue              valuation -1 0.06 industry non-financial
peg                     valuation -1 0.10 industry all
valuation_vs_history    valuation +1 0.14 universe all
shareholder_yield       valuation +1 0.08 industry all
price_to_book           valuation -1 0.06 industry all
"""


def _parse(text: str) -> tuple[Metric, ...]:
    rows = (line.split() for line in text.strip().splitlines())
    pick = {"all": BUSINESS_MODELS, "non-financial": NON_FINANCIAL}
    return tuple(Metric(k, cat, int(d), float(w), basis, pick[models]) for k, cat, d, w, basis, models in rows)


METRICS = _parse(_METRICS)

# Factor-model features by group; a minus sign marks features where less is better.
_FEATURES = """
Momentum     mom_12_1 mom_6_1 ret_63d resid_mom_126d -ret_5d
Trend        px_over_ma50 px_over_ma200 ma_50_200 near_52w_high up_day_ratio
Volatility   -vol_63d -downside_vol_126d -beta_252d -idio_vol_126d max_drawdown_252d
Liquidity    log_dollar_volume -amihud_illiq volume_trend
Value        earnings_yield sales_yield fcf_yield book_to_price
Quality      roe roa gross_margin operating_margin -accruals -leverage current_ratio
Growth       revenue_growth earnings_growth margin_trend fcf_growth
Capital_use  buyback_yield dividend_yield -capex_intensity rnd_intensity
"""
FEATURES = tuple(
    (name.lstrip("-"), line.split()[0].replace("_", " "), -1 if name.startswith("-") else 1)
    for line in _FEATURES.strip().splitlines()
    for name in line.split()[1:]
)

# Risk blend (metric, weight, +1 when more is riskier).
RISK_COMPONENTS = (
    ("volatility", 0.22, 1),
    ("downside_deviation", 0.16, 1),
    ("beta", 0.12, 1),
    ("downside_beta", 0.10, 1),
    ("max_drawdown_1y", 0.14, -1),
    ("amihud", 0.10, 1),
    ("net_debt_to_ebitda", 0.10, 1),
    ("distress_score", 0.06, -1),
)
RISK_LABELS = [(75.0, "High"), (50.0, "Above average"), (25.0, "Below average")]
DISTRESS_LABELS = [(3.0, "Safe"), (1.8, "Grey zone")]
CONFIDENCE_LABELS = [(0.75, "High"), (0.55, "Moderate"), (0.35, "Low")]
# Value-trap signals and their weights.
TRAP_WEIGHTS = {
    "revenue_declining": 1.5,
    "margin_eroding": 1.3,
    "fcf_deteriorating": 1.3,
    "negative_revisions": 1.4,
    "excessive_debt": 1.2,
    "weak_interest_cover": 1.2,
    "persistent_dilution": 1.0,
    "weak_relative_strength": 1.2,
    "below_long_average": 0.8,
    "accounting_quality": 1.3,
    "distress_risk": 1.5,
    "falling_returns": 1.1,
}
TRAP_LABELS = {
    "attractive_value": "Attractively undervalued",
    "speculative_value": "Speculatively undervalued",
    "possible_trap": "Possible value trap",
    "quality_compounder_expensive": "Overvalued high-quality compounder",
    "deteriorating_expensive": "Overvalued and deteriorating",
    "neutral": "No strong value signal",
}
CONFIDENCE_WEIGHTS = {
    "data_completeness": 0.25,
    "data_freshness": 0.15,
    "valuation_agreement": 0.20,
    "score_stability": 0.15,
    "business_predictability": 0.15,
    "analyst_coverage": 0.10,
}
PREDICTABILITY = {"operating": 0.85, "bank": 0.70, "insurer": 0.65, "reit": 0.80, "cyclical": 0.50, "unprofitable_growth": 0.30}
