"""Fundamental panel: as-of joins, guards, metric formulas, risk, confidence and valuation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelstone.functions import numeric as N
from panelstone.functions.spec import CONFIDENCE_WEIGHTS, PREDICTABILITY, TRAP_WEIGHTS
from panelstone.operators import asof as A
from panelstone.operators import factor as X
from panelstone.operators import financial as FM
from panelstone.operators import membership as M
from panelstone.operators import risk as RK
from panelstone.operators import valuation as V
from panelstone.operators.rolling import day_rolling
from panelstone.plans.base import R, Tables, cents, fragment, query, round_sql, rounded
from panelstone.session import cut_lineage

# Reported concepts as expressions over a supplier's quarter; the same text runs on both engines.
CONCEPT_SQL = {
    "revenue": "CASE WHEN cik % 11 = 3 THEN NULL ELSE rev END",
    "operating_expenses": "rev * 0.8",
    "cost_of_revenue": "rev * 0.55 + d * 1000",
    "gross_profit": "CASE WHEN cik % 3 = 0 THEN rev * 0.4 END",
    "operating_income": "rev * 0.15 + (q - 25 * n) * 800",
    "pretax_income": "rev * 0.13 + (q - 25 * n) * 800",
    "tax_expense": "rev * 0.03",
    "net_income": "rev * 0.1 + (q - 25 * n) * 700",
    "net_income_to_common": "CASE WHEN cik % 4 = 0 THEN rev * 0.09 END",
    "interest_expense": "t * 3000",
    "depreciation_amortization": "rev * 0.05",
    "depreciation_only": "CASE WHEN cik % 5 = 0 THEN rev * 0.05 END",
    "amortization_intangibles": "d * 2000",
    "share_based_comp": "CASE WHEN cik % 6 = 0 THEN NULL ELSE n * 500 END",
    "eps_diluted": "2 + d",
    "shares_diluted": "CASE WHEN cik % 7 = 0 THEN NULL ELSE 1000 * (n + 10) END",
    "shares_outstanding": "1000 * (n + 12)",
    "shares_basic": "900 * (n + 10)",
    "rnd": "rev * 0.02",
    "operating_cash_flow": "rev * 0.14 + (q - 25 * n) * 500",
    "capex": "rev * 0.04 + t * 500",
    "acquisitions": "CASE WHEN cik % 8 = 0 THEN rev * 0.03 END",
    "buyback": "d * 900",
    "dividends_paid": "CASE WHEN cik % 2 = 0 THEN t * 800 END",
    "stock_issued": "n * 10",
    "assets": "rev * 2.5 + 100000",
    "current_assets": "rev * 0.9",
    "liabilities": "CASE WHEN cik % 9 = 0 THEN NULL ELSE rev * 1.3 END",
    "current_liabilities": "rev * 0.6 + d * 1500",
    "equity": "rev * 1.0 + (q - 25 * n) * 3000",
    "equity_incl_nci": "CASE WHEN cik % 5 = 1 THEN rev * 1.05 END",
    "minority_interest": "CASE WHEN cik % 5 = 1 THEN rev * 0.05 END",
    "preferred_equity": "CASE WHEN cik % 13 = 0 THEN rev * 0.01 END",
    "cash": "rev * 0.3",
    "short_term_investments": "CASE WHEN cik % 4 = 1 THEN rev * 0.2 END",
    "debt_long": "rev * 0.5",
    "debt_current": "CASE WHEN cik % 3 = 1 THEN rev * 0.1 END",
    "operating_lease_liability": "CASE WHEN cik % 6 = 2 THEN rev * 0.02 END",
    "retained_earnings": "rev * 0.4",
}
fragment(
    "fin",
    "SELECT 'cik' || lpad(CAST(cik AS VARCHAR), 10, '0') AS company_id, 'T' || cik AS ticker, cik, CAST(last_day(qtr + INTERVAL 2 MONTH) AS DATE) + 45 AS date, 20 + q / n AS close_raw, "
    "CASE WHEN cik % 10 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS shares_split_factor, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in CONCEPT_SQL.items()) + """
    FROM (SELECT l_suppkey AS cik, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS qtr, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS rev, sum(l_quantity) AS q,
      CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / 100 AS d, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / 100 AS t FROM lineitem GROUP BY 1, 2)""",
)


def quarters(t: Tables):
    """One row per company and quarter with every reported concept, dated 45 days after the quarter ends."""
    qtr = F.trunc("l_shipdate", "quarter")
    cells = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("cik"), qtr.alias("qtr")).agg(
        cents("l_extendedprice").alias("rev"), F.sum("l_quantity").alias("q"), F.count(F.lit(1)).cast("double").alias("n"), cents("l_discount").alias("d"), cents("l_tax").alias("t"))
    return cells.select(
        F.concat(F.lit("cik"), F.lpad(F.col("cik").cast("string"), 10, "0")).alias("company_id"),
        F.concat(F.lit("T"), F.col("cik").cast("string")).alias("ticker"),
        "cik",
        F.date_add(F.last_day(F.add_months("qtr", 2)), 45).alias("date"),
        (20 + F.col("q") / F.col("n")).alias("close_raw"),
        F.when(F.col("cik") % 10 == 0, 2.0).otherwise(1.0).alias("shares_split_factor"),
        *[F.expr(e).cast("double").alias(c) for c, e in CONCEPT_SQL.items()],
    )


def company_panel(t: Tables):
    """The quarterly panel with availability dates and company attributes."""
    stale = F.when(F.col("cik") % 6 == 0, F.date_sub("date", 200)).otherwise(F.col("date"))
    out = quarters(t).withColumns({"revenue__asof": F.col("date"), "gross_profit__asof": stale})
    return out.join(t.companies.select("company_id", "sector", "industry", "business_model"), "company_id")


fragment("fp", "SELECT fin.*, date AS revenue__asof, CASE WHEN fin.cik % 6 = 0 THEN date - 200 ELSE date END AS gross_profit__asof, sector, industry, business_model FROM fin JOIN co USING (company_id)", "fin", "co")
fragment("b1", """SELECT * REPLACE (coalesce(revenue, operating_income + operating_expenses) AS revenue) FROM fp""", "fp")
fragment("b2", """SELECT * REPLACE (coalesce(CASE WHEN coalesce(revenue__asof - gross_profit__asof, 0) <= 120 THEN gross_profit END, revenue - cost_of_revenue, gross_profit) AS gross_profit),
   coalesce(debt_long, 0) + coalesce(debt_current, 0) AS total_debt, coalesce(cash, 0) + coalesce(short_term_investments, 0) AS cash_and_equivalents, operating_cash_flow - capex AS free_cash_flow FROM b1""", "b1")
fragment("b3", """SELECT * REPLACE (depreciation_amortization + CASE WHEN abs(depreciation_amortization - depreciation_only) < 1 THEN coalesce(amortization_intangibles, 0) ELSE 0 END AS depreciation_amortization),
   least(cash_and_equivalents, greatest(coalesce(equity, 0) + total_debt, 0)) AS cash_usable FROM b2""", "b2")
fragment("b4", """SELECT *, total_debt - cash_usable AS net_debt, operating_income AS ebit, operating_income + coalesce(depreciation_amortization, 0) AS ebitda, free_cash_flow - coalesce(share_based_comp, 0) AS free_cash_flow_ex_sbc,
   CASE WHEN pretax_income > 1e-9 AND tax_expense IS NOT NULL THEN greatest(least(tax_expense / pretax_income, 0.35), 0.10) END AS effective_tax_rate,
   coalesce(shares_diluted, shares_outstanding, shares_basic) * shares_split_factor AS shares_current_basis FROM b3""", "b3")
fragment("fm1", """SELECT * REPLACE (coalesce(CASE WHEN shares_current_basis > 1e-9 THEN coalesce(net_income_to_common, net_income) / shares_current_basis END, eps_diluted) AS eps_diluted),
   close_raw * shares_current_basis AS market_cap, coalesce(equity_incl_nci, equity) + total_debt - cash_and_equivalents AS invested_capital, operating_income * (1 - coalesce(effective_tax_rate, 0.21)) AS nopat,
   close_raw * shares_current_basis + total_debt + coalesce(minority_interest, 0) + coalesce(preferred_equity, 0) + coalesce(operating_lease_liability, 0) - cash_and_equivalents AS enterprise_value FROM b4""", "b4")


def _pos(a, b):
    return f"CASE WHEN ({b}) > 1e-9 THEN ({a}) / ({b}) END"


def _bound(e):
    return f"CASE WHEN ({e}) BETWEEN -1 AND 1 THEN ({e}) END"


fragment("fm2", f"""SELECT *, CASE WHEN count(operating_margin) OVER h >= 8 THEN 1 / (1 + 10 * stddev_samp(operating_margin) OVER h) END AS margin_stability FROM (SELECT *,
   {_pos('nopat', 'invested_capital')} AS roic, {_pos('net_income', 'equity')} AS roe, {_bound(_pos('gross_profit', 'revenue'))} AS gross_margin, {_bound(_pos('operating_income', 'revenue'))} AS operating_margin,
   {_bound(_pos('free_cash_flow', 'revenue'))} AS fcf_margin, {_pos('free_cash_flow', 'net_income')} AS fcf_conversion, {_pos('operating_income', 'interest_expense')} AS interest_coverage,
   {_pos('net_debt', 'ebitda')} AS net_debt_to_ebitda, {_pos('current_assets', 'current_liabilities')} AS current_ratio, {_pos('coalesce(equity_incl_nci, equity)', 'assets')} AS equity_to_assets,
   {_pos('net_income - operating_cash_flow', 'assets')} AS accrual_ratio FROM fm1) WINDOW h AS (PARTITION BY company_id ORDER BY date RANGE BETWEEN INTERVAL 1824 DAY PRECEDING AND CURRENT ROW)""", "fm1")
_LAGS = ", ".join(f"l{y}.{c} AS {c}__lag{y}y" for y in (1, 3, 5) for c in FM.LAGGED)
fragment("fml", f"""SELECT a.*, {_LAGS} FROM fm2 a ASOF LEFT JOIN fm2 l1 ON a.company_id = l1.company_id AND a.date - 365 >= l1.date
   ASOF LEFT JOIN fm2 l3 ON a.company_id = l3.company_id AND a.date - 1095 >= l3.date ASOF LEFT JOIN fm2 l5 ON a.company_id = l5.company_id AND a.date - 1825 >= l5.date""", "fm2")


def _chg(c):
    return f"CASE WHEN abs({c}__lag1y) > 1e-9 THEN ({c} - {c}__lag1y) / abs({c}__lag1y) END"


def _cagr(c, y):
    return f"CASE WHEN {c} > 1e-9 AND {c}__lag{y}y > 1e-9 THEN pow({c} / {c}__lag{y}y, 1.0 / {y}) - 1 END"


fragment("fm3", f"""SELECT *, revenue_growth_1y - revenue_growth_3y AS growth_acceleration FROM (SELECT *, {_chg('revenue')} AS revenue_growth_1y, {_cagr('revenue', 3)} AS revenue_growth_3y, {_cagr('revenue', 5)} AS revenue_growth_5y,
   {_chg('eps_diluted')} AS eps_growth_1y, {_cagr('eps_diluted', 3)} AS eps_growth_3y, {_cagr('free_cash_flow', 3)} AS fcf_growth_3y, {_cagr('gross_profit', 3)} AS gross_profit_growth_3y, {_chg('shares_current_basis')} AS share_count_change,
   operating_margin - operating_margin__lag1y AS margin_trend, {_pos('acquisitions', 'revenue')} AS acquisition_intensity FROM fml)""", "fml")


def _mult(d):
    return f"CASE WHEN {d} > 1e-9 AND enterprise_value > 1e-9 THEN enterprise_value / {d} END"


fragment("fm4", f"""SELECT *, CASE WHEN md > 1e-9 THEN greatest(least((mm - pm) / md, 3.0), -3.0) END AS valuation_vs_history FROM (
   SELECT *, CASE WHEN count(pm) OVER h >= 20 THEN median(pm) OVER h END AS mm, CASE WHEN count(pm) OVER h >= 20 THEN stddev_samp(pm) OVER h END AS md FROM (SELECT *, coalesce(ev_ebit, ev_ebitda, trailing_pe) AS pm FROM (SELECT *,
   {_mult('ebit')} AS ev_ebit, {_mult('ebitda')} AS ev_ebitda, {_mult('revenue')} AS ev_revenue, {_pos('free_cash_flow', 'market_cap')} AS fcf_yield, {_pos('net_income', 'market_cap')} AS earnings_yield,
   {_pos('market_cap', 'coalesce(equity_incl_nci, equity)')} AS price_to_book, {_pos('revenue', 'market_cap')} AS sales_yield,
   {_pos('coalesce(dividends_paid, 0) + coalesce(buyback, 0) - coalesce(stock_issued, 0)', 'market_cap')} AS shareholder_yield, {_pos('dividends_paid', 'market_cap')} AS dividend_yield, {_pos('capex', 'revenue')} AS capex_intensity,
   {_pos('rnd', 'revenue')} AS rnd_intensity, {_pos('close_raw', 'eps_diluted')} AS trailing_pe FROM fm3)) WINDOW h AS (PARTITION BY company_id ORDER BY date RANGE BETWEEN INTERVAL 1824 DAY PRECEDING AND CURRENT ROW))""", "fm3")


def metrics(t: Tables):
    base = cut_lineage(FM.add_quality(FM.add_building_blocks(company_panel(t))))  # read once per lag below
    return FM.add_valuation(FM.add_growth(base))


def _compare(name, sql_src, cols, build, digits=4):
    @query(name, f"{{{{with {sql_src}}}}} " + round_sql(f"SELECT * FROM {sql_src}", ["company_id", "date", *cols], cols, digits))
    def _(t):
        return rounded(build(t).select("company_id", "date", *cols), digits)


_compare("fm1_building_blocks", "fm1", ["revenue", "gross_profit", "total_debt", "cash_usable", "net_debt", "ebitda", "free_cash_flow_ex_sbc", "effective_tax_rate", "market_cap", "eps_diluted", "enterprise_value", "invested_capital", "nopat"],
         lambda t: FM.add_building_blocks(company_panel(t)))
_compare("fm2_quality", "fm2", ["roic", "roe", "gross_margin", "operating_margin", "fcf_margin", "fcf_conversion", "interest_coverage", "net_debt_to_ebitda", "current_ratio", "equity_to_assets", "accrual_ratio", "margin_stability"],
         lambda t: FM.add_quality(FM.add_building_blocks(company_panel(t))))
_compare("fm3_growth", "fm3", ["revenue_growth_1y", "revenue_growth_3y", "revenue_growth_5y", "eps_growth_1y", "eps_growth_3y", "fcf_growth_3y", "gross_profit_growth_3y", "share_count_change", "margin_trend", "growth_acceleration", "acquisition_intensity"], metrics)
_compare("fm4_valuation", "fm4", ["ev_ebit", "ev_ebitda", "ev_revenue", "fcf_yield", "earnings_yield", "price_to_book", "sales_yield", "shareholder_yield", "dividend_yield", "capex_intensity", "rnd_intensity", "trailing_pe", "valuation_vs_history"], metrics)
_compare("wn14_time_range_std", "fm2", ["margin_stability"], lambda t: FM.add_quality(FM.add_building_blocks(company_panel(t))), 6)
_compare("wn16_valuation_vs_history", "fm4", ["valuation_vs_history"], metrics, 5)
_compare("jn9_lagged", "fml", ["revenue__lag1y", "assets__lag3y", "roic__lag5y"], lambda t: FM.lagged(cut_lineage(FM.add_quality(FM.add_building_blocks(company_panel(t)))), list(FM.LAGGED)))

# ---- as-of joins onto the month grid

GRID_CONCEPTS = ["revenue", "gross_profit", "equity", "assets", "shares_diluted", "shares_outstanding"]


def facts_long(t: Tables, concepts=GRID_CONCEPTS):
    cells = F.array(*[F.struct(F.lit(c).alias("concept"), F.col(c).alias("value")) for c in concepts])
    out = quarters(t).select("company_id", F.col("date").alias("available_at"), F.explode(cells).alias("_c")).select("company_id", "available_at", "_c.*")
    return out.where("value is not null")


_ASOF = " ".join(f"ASOF LEFT JOIN (SELECT company_id, date AS d, {c} FROM fin WHERE {c} IS NOT NULL) f{i} ON p.company_id = f{i}.company_id AND p.date >= f{i}.d" for i, c in enumerate(GRID_CONCEPTS))
fragment("grid8", f"SELECT p.company_id, p.ticker, p.date, p.close_adj, " + ", ".join(f"f{i}.{c} AS {c}, f{i}.d AS {c}__asof" for i, c in enumerate(GRID_CONCEPTS)) + f" FROM pan p {_ASOF}", "pan", "fin")


@query("jn8_attach_fundamentals", "{{with grid8}} SELECT company_id, date, " + ", ".join(f"{R(c, 3)} AS {c}, {c}__asof" for c in GRID_CONCEPTS) + " FROM grid8")
def _(t):
    out = A.attach_wide(t.panel.select("company_id", "ticker", "date", "close_adj"), facts_long(t), GRID_CONCEPTS)
    return rounded(out.drop("ticker", "close_adj"), 3)


@query("jn10_share_basis", f"""{{{{with grid8, px}}}}, sf AS (SELECT ticker, date, exp(sum(ln(coalesce(split_ratio, 1.0))) OVER (PARTITION BY ticker) - sum(ln(coalesce(split_ratio, 1.0))) OVER (PARTITION BY ticker ORDER BY date)) AS split_factor FROM px),
   e AS (SELECT ticker, arg_min(split_factor, date) AS f0 FROM sf GROUP BY 1), g AS (SELECT *, coalesce(shares_diluted__asof, shares_outstanding__asof) AS sa FROM grid8)
   SELECT company_id, g.date, {R('coalesce(CASE WHEN sa IS NOT NULL THEN s.split_factor END, f0, 1.0)')} AS shares_split_factor FROM g ASOF LEFT JOIN sf s ON g.ticker = s.ticker AND g.sa >= s.date LEFT JOIN e ON e.ticker = g.ticker""")
def _(t):
    from panelstone.operators.prices import add_split_factor
    grid = A.attach_wide(t.panel.select("company_id", "ticker", "date"), facts_long(t), GRID_CONCEPTS)
    return rounded(FM.attach_share_basis(grid, add_split_factor(t.prices)).select("company_id", "date", "shares_split_factor"))


@query("jn11_asof_without_key", f"""{{{{with pan, mk}}}} SELECT company_id, p.date, {R('m.close')} AS level FROM pan p ASOF LEFT JOIN (SELECT date + 3 AS date, close FROM mk) m ON p.date >= m.date""")
def _(t):
    series = t.market.select(F.date_add("date", 3).alias("date"), "close_adj")
    dates = t.panel.select("date").distinct()  # the unkeyed timeline holds calendar dates only
    at = A.asof_backward(dates, series, [], "date", "date", {"close_adj": "level"})
    return rounded(t.panel.select("company_id", "date").join(F.broadcast(at), "date"))


@query("jn13_filled_wide", f"""{{{{with fin, pan}}}}, f AS (SELECT company_id, date AS d, last_value(gross_profit IGNORE NULLS) OVER w AS gross_profit, last_value(revenue IGNORE NULLS) OVER w AS revenue FROM fin WHERE revenue IS NOT NULL OR gross_profit IS NOT NULL
   WINDOW w AS (PARTITION BY company_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
   SELECT p.company_id, p.date, {R('revenue', 3)} AS revenue, {R('gross_profit', 3)} AS gross_profit FROM pan p ASOF LEFT JOIN f ON p.company_id = f.company_id AND p.date >= f.d""")
def _(t):
    wide = A.filled_wide(facts_long(t, ["revenue", "gross_profit"]), ["revenue", "gross_profit"], "company_id", "available_at")
    out = A.asof_backward(t.panel.select("company_id", "date"), wide, ["company_id"], "date", "available_at", {"revenue": "revenue", "gross_profit": "gross_profit"})
    return rounded(out, 3)


@query("jn8_asof_events_split_timeline", f"""SELECT l.event_id, {R('r.value')} AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') l
   ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def _(t):
    ev = t.raw("events").select("event_id", "user_id", "ts", "event_type", "value")
    left = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = ev.where("event_type = 'view'").select(F.col("event_id").alias("vid"), "user_id", "ts", "value")
    out = A.asof_backward(left, right, ["user_id"], "ts", "ts", {"value": "last_view"}, ["vid"], bucket=F.to_date("_at"))
    return rounded(out.select("event_id", "last_view"))


# ---- guards and scalar functions, over order lines

_LI = "l_orderkey, l_linenumber"


def _lines(t, **cols):
    return rounded(t.raw("lineitem").select("l_orderkey", "l_linenumber", *[e.alias(n) for n, e in cols.items()]))


@query("fn1_safe_div", f"SELECT {_LI}, {R('CASE WHEN abs(l_discount) > 1e-9 THEN l_tax / l_discount END')} AS plain, {R('CASE WHEN l_discount > 1e-9 AND l_tax > 1e-9 THEN l_tax / l_discount END')} AS strict FROM lineitem")
def _(t):
    return _lines(t, plain=N.safe_div("l_tax", "l_discount"), strict=N.safe_div("l_tax", "l_discount", positive_only=True, numerator_positive=True))


@query("fn2_bounded", f"SELECT {_LI}, {R('CASE WHEN l_discount BETWEEN 0.02 AND 0.07 THEN l_discount END')} AS closed, {R('CASE WHEN l_quantity > 10 AND l_quantity < 20 THEN l_quantity END')} AS open_interval FROM lineitem")
def _(t):
    return _lines(t, closed=N.bounded("l_discount", 0.02, 0.07), open_interval=N.inside("l_quantity", 10, 20))


@query("fn4_clip", f"SELECT {_LI}, {R('greatest(least(l_quantity, 40), 10)')} AS clipped FROM lineitem")
def _(t):
    return _lines(t, clipped=N.clip("l_quantity", 10, 40))


@query("fn5_cagr", f"SELECT {_LI}, {R('CASE WHEN l_discount > 1e-9 AND l_tax > 1e-9 THEN pow(l_tax / l_discount, 1.0 / 3) - 1 END')} AS growth FROM lineitem")
def _(t):
    return _lines(t, growth=N.cagr("l_tax", "l_discount", 3))


@query("fn6_coalesce", f"SELECT {_LI}, {R('coalesce(nullif(l_discount, 0), nullif(l_tax, 0), 1)')} AS first_known FROM lineitem")
def _(t):
    return _lines(t, first_known=N.either(F.nullif("l_discount", F.lit(0.0)), F.nullif("l_tax", F.lit(0.0)), 1.0))


@query("fn7_row_extremes", f"SELECT {_LI}, {R('least(l_discount, l_tax)')} AS lo, {R('greatest(l_discount, l_tax)')} AS hi, {R('l_discount + l_tax')} AS total FROM lineitem")
def _(t):
    return _lines(t, lo=F.least("l_discount", "l_tax"), hi=F.greatest("l_discount", "l_tax"), total=F.col("l_discount") + F.col("l_tax"))


@query("fn8_dates", """SELECT l_orderkey, l_linenumber, CAST(datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS days, CAST(l_shipdate AS DATE) + 45 AS later, CAST(year(l_shipdate) AS INTEGER) AS y,
   CAST(date_trunc('month', l_shipdate) AS DATE) AS m, CAST(isoyear(l_shipdate) AS INTEGER) AS iso_year, CAST(week(l_shipdate) AS INTEGER) AS iso_week FROM lineitem""")
def _(t):
    d = F.col("l_shipdate").cast("date")
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", F.datediff(d, F.lit("1995-01-01").cast("date")).alias("days"), F.date_add(d, 45).alias("later"), F.year(d).alias("y"),
                                    F.trunc(d, "MM").alias("m"), F.extract(F.lit("YEAROFWEEK"), d).cast("int").alias("iso_year"), F.weekofyear(d).alias("iso_week"))


@query("fn9_strings", "SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, p_brand || ' / ' || p_type AS joined, contains(p_name, 'red') AS has_red, replace(p_brand, '#', '-') AS dashed, split_part(p_name, ' ', 1) AS head, length(p_name) AS n FROM part")
def _(t):
    return t.raw("part").select("p_partkey", F.upper("p_name").alias("up"), F.lower("p_type").alias("low"), F.concat("p_brand", F.lit(" / "), "p_type").alias("joined"), F.col("p_name").contains("red").alias("has_red"),
                                F.regexp_replace("p_brand", "#", "-").alias("dashed"), F.split("p_name", " ")[0].alias("head"), F.length("p_name").cast("long").alias("n"))


@query("fn10_value_map", "SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'XLP' WHEN 'MACHINERY' THEN 'XLI' WHEN 'AUTOMOBILE' THEN 'XLY' ELSE 'OTHER' END AS fund FROM customer")
def _(t):
    return t.raw("customer").select("c_custkey", N.mapped("c_mktsegment", {"HOUSEHOLD": "XLP", "MACHINERY": "XLI", "AUTOMOBILE": "XLY"}, "OTHER").alias("fund"))


@query("fn11_score_band", f"SELECT {_LI}, CASE WHEN l_quantity * 2 >= 68 THEN 'Very attractive' WHEN l_quantity * 2 >= 60 THEN 'Attractive' WHEN l_quantity * 2 >= 42 THEN 'Neutral' WHEN l_quantity * 2 >= 33 THEN 'Unattractive' ELSE 'Very unattractive' END AS band FROM lineitem")
def _(t):
    from panelstone.operators.scoring import score_band
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", score_band(F.col("l_quantity") * 2).alias("band"))


@query("fn12_identifiers", "SELECT s_suppkey, 'cik' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS company_id, CASE WHEN s_suppkey = 0 THEN 'TKR' || upper(s_name) || ':2020-01-31' ELSE 'cik' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') END AS security_id, sha256(s_name || '|' || coalesce(CAST(nullif(s_nationkey, 3) AS VARCHAR), 'None')) AS event_id FROM supplier")
def _(t):
    s = t.raw("supplier").withColumn("seen", F.lit("2020-01-31").cast("date"))
    return s.select("s_suppkey", M.company_id("s_suppkey").alias("company_id"), M.security_id("s_suppkey", "s_name", "seen").alias("security_id"), M.event_id("s_name", F.nullif("s_nationkey", F.lit(3))).alias("event_id"))


@query("fn13_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS k_text FROM events")
def _(t):
    parsed = F.from_json("props", "struct<k: bigint>")
    packed = F.to_json(F.struct(parsed["k"].alias("k")))
    return t.raw("events").select("event_id", parsed["k"].alias("k"), F.get_json_object(packed, "$.k").alias("k_text"))


@query("fn14_math", f"SELECT {_LI}, {R('ln(l_quantity)')} AS a, {R('sqrt(l_quantity)')} AS b, {R('pow(l_quantity, 0.3)')} AS c, {R('abs(l_discount - l_tax)')} AS d, {R('exp(l_discount)')} AS e FROM lineitem")
def _(t):
    return _lines(t, a=F.log("l_quantity"), b=F.sqrt("l_quantity"), c=F.pow("l_quantity", F.lit(0.3)), d=F.abs(F.col("l_discount") - F.col("l_tax")), e=F.exp("l_discount"))


@query("fn15_business_model", """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN CASE p_size % 3 WHEN 0 THEN 'bank' WHEN 1 THEN 'insurer' ELSE 'operating' END WHEN p_size % 5 = 1 THEN CASE WHEN p_size % 2 = 0 THEN 'reit' ELSE 'operating' END
   WHEN p_size % 5 = 2 THEN 'cyclical' WHEN contains(p_name, 'gold') OR contains(p_name, 'steel') THEN 'cyclical' ELSE 'operating' END AS model FROM part""")
def _(t):
    size = F.col("p_size")
    sector = F.when(size % 5 == 0, "Financials").when(size % 5 == 1, "Real Estate").when(size % 5 == 2, "Energy").otherwise("Technology")
    industry = (F.when((size % 5 == 0) & (size % 3 == 0), "Regional Banks").when((size % 5 == 0) & (size % 3 == 1), "Reinsurance").when(size % 5 == 0, "Asset Management & Custody Banks")
                .when((size % 5 == 1) & (size % 2 == 0), "Retail REITs").when(size % 5 == 1, "Real Estate Services").otherwise(F.col("p_name")))
    df = t.raw("part").withColumns({"sector": sector, "industry": industry})
    return df.select("p_partkey", M.classify_business_model("sector", "industry").alias("model"))


@query("fn16_unprofitable_override", "{{with fml}} SELECT company_id, date, CASE WHEN net_income < 0 AND net_income__lag1y < 0 AND business_model = 'operating' THEN 'unprofitable_growth' ELSE business_model END AS business_model FROM fml")
def _(t):
    base = cut_lineage(FM.add_quality(FM.add_building_blocks(company_panel(t))))
    return FM.lagged(base, ["net_income"], (1,)).select("company_id", "date", M.override_unprofitable().alias("business_model"))


@query("fn18_labels", f"SELECT {_LI}, CASE WHEN l_quantity / 10 >= 3 THEN 'Safe' WHEN l_quantity / 10 >= 1.8 THEN 'Grey zone' ELSE 'Distress zone' END AS distress, CASE WHEN l_quantity * 2 >= 75 THEN 'High' WHEN l_quantity * 2 >= 50 THEN 'Above average' WHEN l_quantity * 2 >= 25 THEN 'Below average' ELSE 'Low' END AS risk, CASE WHEN l_quantity / 50 >= 0.75 THEN 'High' WHEN l_quantity / 50 >= 0.55 THEN 'Moderate' WHEN l_quantity / 50 >= 0.35 THEN 'Low' ELSE 'Very low' END AS confidence FROM lineitem")
def _(t):
    q = F.col("l_quantity")
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", RK.distress_label(q / 10).alias("distress"), RK.risk_label(q * 2).alias("risk"), RK.confidence_label(q / 50).alias("confidence"))


@query("fn20_sanitise", f"""{{{{with fwd}}}} SELECT company_id, date, {R('coalesce(mom_12_1, (SELECT median(mom_12_1) FROM fwd))')} AS mom_12_1, {R('coalesce(fcf_margin, (SELECT median(fcf_margin) FROM fwd))')} AS fcf_margin FROM fwd WHERE fwd_1m IS NOT NULL""")
def _(t):
    return rounded(X.sanitise(t.forward, ["mom_12_1", "fcf_margin"], "fwd_1m").select("company_id", "date", "mom_12_1", "fcf_margin"))


# ---- strength, traps, confidence

fragment("rk", """SELECT *, CASE WHEN business_model IN ('operating', 'cyclical', 'unprofitable_growth') THEN 1.2 * (current_assets - current_liabilities) / assets + 1.4 * retained_earnings / assets + 3.3 * ebit / assets
     + 0.6 * market_cap / coalesce(liabilities, assets - coalesce(equity_incl_nci, equity)) + revenue / assets END AS distress_score,
   (CASE WHEN net_income > 0 THEN 1 ELSE 0 END) + (CASE WHEN operating_cash_flow > 0 THEN 1 ELSE 0 END) + (CASE WHEN net_income / assets > net_income__lag1y / assets__lag1y THEN 1 ELSE 0 END) + (CASE WHEN operating_cash_flow > net_income THEN 1 ELSE 0 END)
   + (CASE WHEN total_debt / assets < total_debt__lag1y / assets__lag1y THEN 1 ELSE 0 END) + (CASE WHEN current_ratio > current_ratio__lag1y THEN 1 ELSE 0 END) + (CASE WHEN share_count_change <= 0 THEN 1 ELSE 0 END)
   + (CASE WHEN gross_margin > gross_margin__lag1y THEN 1 ELSE 0 END) + (CASE WHEN revenue / assets > revenue__lag1y / assets__lag1y THEN 1 ELSE 0 END) AS piotroski FROM fm3""", "fm3")


def strength(t: Tables):
    base = cut_lineage(FM.add_quality(FM.add_building_blocks(company_panel(t))))
    return FM.add_growth(base).withColumns({"distress_score": RK.altman_z(), "piotroski": RK.piotroski()})


@query("rk1_altman_z", f"{{{{with rk}}}} SELECT company_id, date, {R('distress_score')} AS distress_score FROM rk")
def _(t):
    return rounded(strength(t).select("company_id", "date", "distress_score"))


@query("rk2_piotroski", "{{with rk}} SELECT company_id, date, CAST(piotroski AS INTEGER) AS piotroski FROM rk")
def _(t):
    return strength(t).select("company_id", "date", F.col("piotroski").cast("int").alias("piotroski"))


_TRAP = {
    "revenue_declining": "revenue_growth_1y < -0.01", "margin_eroding": "margin_trend < -0.02", "fcf_deteriorating": "free_cash_flow < 0 OR fcf_growth_3y < -0.15", "negative_revisions": "sin(hash(cik)) < -2",
    "excessive_debt": "net_debt_to_ebitda > 4", "weak_interest_cover": "interest_coverage < 3", "persistent_dilution": "share_count_change > 0.02", "weak_relative_strength": "margin_trend < -0.2",
    "below_long_average": "margin_trend < 0 AND revenue_growth_1y < 0", "accounting_quality": "accrual_ratio > 0.08", "distress_risk": "distress_score < 1.8", "falling_returns": "roic - roic__lag1y < -0.03",
}
fragment("tr", "SELECT *, 100.0 * (" + " + ".join(f"CASE WHEN {c} THEN {TRAP_WEIGHTS[k]} ELSE 0 END" for k, c in _TRAP.items() if k != "negative_revisions") + f")::DOUBLE / {sum(TRAP_WEIGHTS.values())} AS trap_score, "
         + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for k, c in _TRAP.items() if k != "negative_revisions") + " AS n_fired, CASE cik % 4 WHEN 0 THEN 'undervalued' WHEN 1 THEN 'significantly_overvalued' WHEN 2 THEN 'fairly_valued' ELSE 'significantly_undervalued' END AS vclass, CASE WHEN cik % 3 = 0 THEN 70.0 WHEN cik % 3 = 1 THEN 50.0 END AS quality FROM rk", "rk")


def traps(t: Tables):
    k = F.col("cik")
    df = strength(t).withColumns({
        "eps_revision_3m": F.lit(None).cast("double"), "rel_strength_spy": F.col("margin_trend"), "px_over_ma200": F.col("margin_trend"), "ma200_slope": F.col("revenue_growth_1y"),
        "valuation_class": F.when(k % 4 == 0, "undervalued").when(k % 4 == 1, "significantly_overvalued").when(k % 4 == 2, "fairly_valued").otherwise("significantly_undervalued"),
        "quality": F.when(k % 3 == 0, 70.0).when(k % 3 == 1, 50.0)})
    return RK.assess_value_traps(df)


@query("rk3_value_trap", f"{{{{with tr}}}} SELECT company_id, date, {R('trap_score')} AS trap_score, CAST(n_fired AS INTEGER) AS n_fired FROM tr")
def _(t):
    return rounded(traps(t).select("company_id", "date", "trap_score", F.col("n_fired").cast("int").alias("n_fired")))


@query("rk4_classify_trap", """{{with tr}} SELECT company_id, date, CASE WHEN vclass LIKE '%undervalued' THEN CASE WHEN trap_score >= 35 THEN 'possible_trap' WHEN trap_score >= 18 OR coalesce(quality, 0) < 65 THEN 'speculative_value' ELSE 'attractive_value' END
   WHEN vclass LIKE '%overvalued' THEN CASE WHEN trap_score >= 30 THEN 'deteriorating_expensive' WHEN quality >= 65 THEN 'quality_compounder_expensive' WHEN trap_score >= 20 THEN 'deteriorating_expensive' ELSE 'neutral' END ELSE 'neutral' END AS classification FROM tr""")
def _(t):
    return traps(t).select("company_id", "date", "classification")


_PRED = " ".join(f"WHEN '{k}' THEN {v}" for k, v in PREDICTABILITY.items())
fragment("cf", f"""SELECT company_id, date, greatest(least(0.25 * greatest(least(coalesce(cov, 0.5), 1), 0) + 0.15 * CASE WHEN age <= 45 THEN 1.0 WHEN age <= 100 THEN 0.85 WHEN age <= 140 THEN 0.6 ELSE greatest(least(0.4 - (age - 140) / 500.0, 1), 0) END
   + 0.2 * CASE WHEN vc IS NULL THEN 0.35 ELSE greatest(least(vc, 1), 0) END + 0.15 * CASE WHEN ch IS NULL THEN 0.6 ELSE greatest(least(1 - abs(ch) / 40, 1), 0) END + 0.15 * CASE business_model {_PRED} ELSE 0.6 END
   + 0.1 * CASE WHEN na IS NULL THEN 0.5 WHEN na >= 15 THEN 1.0 WHEN na >= 8 THEN 0.8 WHEN na >= 3 THEN 0.55 ELSE 0.3 END, 1), 0)::DOUBLE AS confidence FROM (
   SELECT company_id, date, business_model, fcf_margin AS cov, CAST(n AS INTEGER) * 9 AS age, roic * 12 AS vc, ret_3m * 50 AS ch, CASE WHEN n % 4 = 0 THEN NULL ELSE n END AS na FROM pan)""", "pan")


def confidence_inputs(t: Tables):
    return t.panel.withColumns({"metric_coverage": F.col("fcf_margin"), "data_age_days": F.col("n") * 9, "valuation_confidence": F.col("roic") * 12, "score_change_1m": F.col("ret_3m") * 50, "n_analysts": F.when(F.col("n") % 4 != 0, F.col("n"))})


@query("cf1_confidence", f"{{{{with cf}}}} SELECT company_id, date, {R('confidence')} AS confidence, CASE WHEN round(confidence, 9) >= 0.75 THEN 'High' WHEN round(confidence, 9) >= 0.55 THEN 'Moderate' WHEN round(confidence, 9) >= 0.35 THEN 'Low' ELSE 'Very low' END AS label FROM cf")
def _(t):
    out = RK.add_confidence(confidence_inputs(t))
    return rounded(out.select("company_id", "date", "confidence", F.col("confidence_label").alias("label")))


@query("cf2_attach_confidence", f"{{{{with cf}}}} SELECT company_id, date, CASE WHEN date = (SELECT max(date) FROM cf) THEN {R('confidence')} END AS confidence FROM cf")
def _(t):
    ctx = confidence_inputs(t)
    scores = ctx.select("company_id", "date", "business_model", "score_change_1m")
    last = F.broadcast(ctx.agg(F.max("date").alias("date")))
    context = ctx.join(last, "date", "left_semi").select("company_id", "metric_coverage", "data_age_days", "valuation_confidence", "n_analysts")
    return rounded(RK.attach_confidence(scores, context).select("company_id", "date", "confidence"))


@query("fm7_peg", f"""{{{{with fm3}}}} SELECT company_id, date, {R('CASE WHEN close_raw / eps_diluted > 0 AND revenue_growth_1y > 0.01 THEN close_raw / eps_diluted / (revenue_growth_1y * 100) END')} AS peg FROM fm3""")
def _(t):
    pe = N.div("close_raw", "eps_diluted")
    peg = F.when((pe > 0) & (F.col("revenue_growth_1y") > 0.01), N.div(pe, F.col("revenue_growth_1y") * 100))
    return rounded(strength(t).select("company_id", "date", peg.alias("peg")))


@query("fm6_provider_cross_check", f"""{{{{with fm1}}}}, p AS (SELECT *, CASE WHEN cik % 12 = 0 THEN shares_current_basis * 8 ELSE shares_current_basis * 1.1 END AS provider FROM fm1)
   SELECT company_id, date, CASE WHEN provider / shares_current_basis > 5 OR provider / shares_current_basis < 0.2 THEN 'provider' ELSE 'filing' END AS source, {R('close_raw * CASE WHEN provider / shares_current_basis > 5 OR provider / shares_current_basis < 0.2 THEN provider ELSE shares_current_basis END', 3)} AS market_cap FROM p""")
def _(t):
    df = FM.add_building_blocks(company_panel(t)).withColumn("provider_shares", F.when(F.col("cik") % 12 == 0, F.col("shares_current_basis") * 8).otherwise(F.col("shares_current_basis") * 1.1))
    return rounded(FM.provider_cross_check(df).select("company_id", "date", F.col("share_source").alias("source"), "market_cap"), 3)


_FF = ["earnings_yield", "sales_yield", "fcf_yield", "book_to_price", "roe", "roa", "gross_margin", "accruals", "leverage", "capex_intensity", "revenue_growth", "earnings_growth", "margin_trend"]
fragment("ff", f"""SELECT *, {_pos('net_income', 'market_cap')} AS earnings_yield, {_pos('revenue', 'market_cap')} AS sales_yield, {_pos('fcf', 'market_cap')} AS fcf_yield, {_pos('equity', 'market_cap')} AS book_to_price, {_pos('net_income', 'equity')} AS roe, {_pos('net_income', 'assets')} AS roa,
   gross_profit / revenue AS gross_margin, {_pos('net_income - operating_cash_flow', 'assets')} AS accruals, {_pos('coalesce(debt_long, 0) + coalesce(debt_current, 0)', 'equity')} AS leverage, {_pos('capex', 'revenue')} AS capex_intensity,
   (revenue - lag(revenue, 4) OVER w) / abs(lag(revenue, 4) OVER w) AS revenue_growth, (net_income - lag(net_income, 4) OVER w) / abs(lag(net_income, 4) OVER w) AS earnings_growth, om - lag(om, 4) OVER w AS margin_trend
   FROM (SELECT *, close_raw * shares_outstanding * shares_split_factor AS market_cap, operating_cash_flow - capex AS fcf, operating_income / revenue AS om FROM fin) WINDOW w AS (PARTITION BY ticker ORDER BY date)""", "fin")


@query("fm8_factor_fundamentals", "{{with ff}} " + round_sql("SELECT * FROM ff", ["ticker", "date", *_FF], _FF, 5))
def _(t):
    df = quarters(t).withColumns({"close_split": F.col("close_raw"), "shares": F.col("shares_outstanding"), "split_factor": F.col("shares_split_factor")})
    return rounded(X.fundamental_features(df, year=4).select("ticker", "date", *_FF), 5)


# ---- valuation

fragment("vi", """SELECT company_id, ticker, cik, date, sector, industry, business_model, revenue, operating_margin, effective_tax_rate AS tax_rate, shares_current_basis AS shares, net_debt, minority_interest, preferred_equity, revenue_growth_1y AS growth_rate, roic,
   0.8 + cik % 7 * 0.25 AS beta, market_cap, free_cash_flow, ebit, ebitda, net_income, equity, revenue_growth_1y AS growth, operating_margin AS margin, ev_ebit, ev_ebitda, ev_revenue, fcf_yield, trailing_pe, price_to_book, capex, acquisitions, invested_capital,
   revenue__lag1y, revenue__lag3y, revenue__lag5y, close_raw AS price, eps_diluted * 1.1 AS forward_eps FROM fm4""", "fm4")


def inputs(t: Tables):
    c = F.col
    return metrics(t).withColumns({
        "tax_rate": c("effective_tax_rate"), "shares": c("shares_current_basis"), "growth_rate": c("revenue_growth_1y"), "beta": F.lit(0.8) + c("cik") % 7 * 0.25, "growth": c("revenue_growth_1y"), "margin": c("operating_margin"),
        "price": c("close_raw"), "forward_eps": c("eps_diluted") * 1.1, "reported_free_cash_flow": c("free_cash_flow")})


@query("va3_sales_to_capital", f"""{{{{with vi}}}}, s AS (SELECT *, greatest(coalesce(capex, 0), 0) + greatest(coalesce(acquisitions, 0), 0) AS sp FROM vi),
   c AS (SELECT *, CASE WHEN revenue > revenue__lag5y AND sp > 0 THEN (revenue - revenue__lag5y) / (5 * sp) END AS c5, CASE WHEN revenue > revenue__lag3y AND sp > 0 THEN (revenue - revenue__lag3y) / (3 * sp) END AS c3, CASE WHEN revenue > revenue__lag1y AND sp > 0 THEN (revenue - revenue__lag1y) / sp END AS c1,
     CASE WHEN revenue > 0 AND invested_capital > 0 THEN revenue / invested_capital END AS bk FROM s),
   o AS (SELECT *, coalesce(CASE WHEN c5 > 0.1 AND c5 < 20 THEN c5 END, CASE WHEN c3 > 0.1 AND c3 < 20 THEN c3 END, CASE WHEN c1 > 0.1 AND c1 < 20 THEN c1 END) AS own FROM c)
   SELECT company_id, date, {R('coalesce(own, median(own) OVER (PARTITION BY date, sector), CASE WHEN bk > 0.1 AND bk < 20 THEN bk END)')} AS sales_to_capital FROM o""")
def _(t):
    return rounded(V.sales_to_capital(cut_lineage(inputs(t))).select("company_id", "date", "sales_to_capital"))


@query("va4_risk_free", f"{{{{with mk}}}} SELECT {R('CASE WHEN y > 0.001 AND y < 0.2 THEN y ELSE 0.042 END')} AS risk_free_rate FROM (SELECT arg_max(close, date) / 1000 AS y FROM mk)")
def _(t):
    return rounded(V.risk_free_rate(t.market.select("date", (F.col("close_adj") / 10).alias("close"))))


_COE = "greatest(least(0.042 + greatest(least(beta, 2.0), 0.6) * 0.05 + {x} + CASE WHEN market_cap < 1e10 THEN 0.01 ELSE 0 END, 0.16), 0.055)"


@query("va5_cost_of_equity", f"{{{{with vi}}}} SELECT company_id, date, {R(_COE.format(x='0'))} AS cost_of_equity FROM vi")
def _(t):
    return rounded(inputs(t).select("company_id", "date", V.cost_of_equity("beta", F.lit(V.RISK_FREE), "market_cap").alias("cost_of_equity")))


@query("va6_growth_estimate", f"""{{{{with fm3}}}} SELECT company_id, date, {R('CASE WHEN revenue_growth_1y IS NULL AND eps_growth_1y IS NULL THEN 0.03 ELSE greatest(least(coalesce(0.45 * revenue_growth_1y + 0.55 * eps_growth_1y, revenue_growth_1y, eps_growth_1y), 0.4), -0.25) END')} AS growth FROM fm3""")
def _(t):
    df = strength(t).withColumns({"revenue_growth": F.col("revenue_growth_1y"), "forward_eps_growth": F.col("eps_growth_1y")})
    return rounded(df.select("company_id", "date", V.growth_estimate().alias("growth")))


_SCN = ", ".join(f"('{a}', {b}, {c}, {d}, {e}, {f})" for a, b, c, d, e, f, _ in V.SCENARIOS)
fragment("dcf", f"""WITH RECURSIVE s AS (SELECT vi.*, scenario, fs, ms, {_COE.format(x='rs')} AS rate, least(greatest(coalesce(growth_rate, 0) * gm, -0.25), 0.40) AS g0, ts, CASE WHEN coalesce(tax_rate, 0) <> 0 THEN greatest(least(tax_rate, 0.35), 0.10) ELSE 0.21 END AS tax
     FROM vi, (VALUES {_SCN}) x(scenario, gm, ms, fs, ts, rs) WHERE revenue > 0 AND shares > 0 AND operating_margin IS NOT NULL),
   e AS (SELECT *, least(0.025 + ts, 0.035, rate - 0.01) AS ge FROM s),
   y AS (SELECT company_id, date, scenario, 0 AS t, revenue AS r, 0.0::DOUBLE AS fcf, 0.0::DOUBLE AS nopat, 0.0::DOUBLE AS pv FROM e UNION ALL
     SELECT y.company_id, y.date, y.scenario, t + 1, r * (1 + g), r * (1 + g) * m * (1 - tax) - greatest(r * g, 0) / 2.0, r * (1 + g) * m * (1 - tax), (r * (1 + g) * m * (1 - tax) - greatest(r * g, 0) / 2.0) / pow(1 + rate, t + 1)
     FROM (SELECT y.*, e.tax, e.rate, g0 + (ge - g0) * pow((t + 1) / 10.0, 1 / fs) AS g, operating_margin + ms * least((t + 1) / 5.0, 1) AS m FROM y JOIN e USING (company_id, date, scenario) WHERE t < 10) y),
   a AS (SELECT company_id, date, scenario, sum(pv) AS pv, max(CASE WHEN t = 10 THEN nopat END) AS np, max(CASE WHEN t = 1 THEN fcf END) AS f1 FROM y GROUP BY 1, 2, 3)
   SELECT e.*, pv, f1, np * (1 + ge) * (1 - greatest(least(ge / CASE WHEN roic > rate THEN least(roic, rate + 0.05) ELSE rate + 0.01 END, 0.9), 0)) / (rate - ge) / pow(1 + rate, 10) AS tpv FROM e JOIN a USING (company_id, date, scenario)""", "vi")


@query("va7_dcf_project", f"""{{{{with dcf}}}} SELECT company_id, date, scenario, {R('rate')} AS rate, {R('(pv + tpv - coalesce(net_debt, 0) - coalesce(minority_interest, 0) - coalesce(preferred_equity, 0)) / shares', 4)} AS value_per_share,
   {R('CASE WHEN pv + tpv > 1e-9 THEN tpv / (pv + tpv) END', 5)} AS terminal_share, pv + tpv <= 0 AS ev_negative, coalesce(free_cash_flow > 0 AND f1 < 0 AND (free_cash_flow - f1) / revenue > 0.1, false) AS contradicts_fcf FROM dcf""")
def _(t):
    out = V.run_scenarios(inputs(t).withColumn("sales_to_capital", F.lit(2.0)))
    return rounded(out.select("company_id", "date", "scenario", "rate", "value_per_share", "terminal_share", "ev_negative", "contradicts_fcf"), 4, rate=6, terminal_share=5)


@query("va8_scenarios", f"""{{{{with dcf}}}}, v AS (SELECT company_id, date, scenario, (pv + tpv - coalesce(net_debt, 0) - coalesce(minority_interest, 0) - coalesce(preferred_equity, 0)) / shares AS v FROM dcf)
   SELECT company_id, date, {R("max(CASE scenario WHEN 'bear' THEN v END)", 4)} AS bear, {R("max(CASE scenario WHEN 'base' THEN v END)", 4)} AS base, {R("max(CASE scenario WHEN 'bull' THEN v END)", 4)} AS bull FROM v GROUP BY 1, 2""")
def _(t):
    out = V.run_scenarios(inputs(t).withColumn("sales_to_capital", F.lit(2.0)))
    cell = lambda s: F.max(F.when(F.col("scenario") == s, F.col("value_per_share"))).alias(s)
    return rounded(out.groupBy("company_id", "date").agg(cell("bear"), cell("base"), cell("bull")), 4)


@query("va9_sensitivity")
def _(t):
    return rounded(V.sensitivity(inputs(t).withColumn("sales_to_capital", F.lit(2.0)), ["company_id", "date"]), 4)


fragment("pk", "SELECT *, CASE WHEN count(*) OVER (PARTITION BY date, industry) - 1 >= 6 THEN 'industry' ELSE 'sector' END AS pkind FROM vi", "vi")
fragment("peer", """SELECT a.company_id, a.date, 'ev_ebit' AS multiple, list(b.ev_ebit) FILTER (b.ev_ebit > 0) AS l FROM pk a JOIN pk b ON a.date = b.date AND a.company_id <> b.company_id AND CASE a.pkind WHEN 'industry' THEN a.industry = b.industry ELSE a.sector = b.sector END GROUP BY 1, 2
   UNION ALL SELECT a.company_id, a.date, 'price_to_book', list(b.price_to_book) FILTER (b.price_to_book > 0) FROM pk a JOIN pk b ON a.date = b.date AND a.company_id <> b.company_id AND CASE a.pkind WHEN 'industry' THEN a.industry = b.industry ELSE a.sector = b.sector END GROUP BY 1, 2""", "pk")
fragment("peer2", """SELECT company_id, date, multiple, count(*) AS n, quantile_cont(x, 0.25) AS q_low, quantile_cont(x, 0.75) AS q_high, quantile_cont(x, 0.2) AS a, quantile_cont(x, 0.8) AS b FROM (SELECT company_id, date, multiple, unnest(l) AS x FROM peer) GROUP BY 1, 2, 3""", "peer")


@query("va1_peer_multiples", f"""{{{{with peer, peer2}}}}, m AS (SELECT p.company_id, p.date, p.multiple, median(x) AS med FROM (SELECT company_id, date, multiple, unnest(l) AS x FROM peer) p JOIN peer2 q USING (company_id, date, multiple) WHERE n < 5 OR x BETWEEN a AND b GROUP BY 1, 2, 3)
   SELECT company_id, date, multiple, n, {R('q_low', 5)} AS q_low, {R('q_high', 5)} AS q_high, {R('med', 5)} AS trimmed_median FROM peer2 JOIN m USING (company_id, date, multiple)""")
def _(t):
    df = V.choose_peer_group(cut_lineage(inputs(t)))
    out = V.peer_statistics(df, ["ev_ebit", "price_to_book"], V.PEER_TRIM, {"q_low": 0.25, "q_high": 0.75})
    out = out.where("loo_n > 0").select("company_id", "date", "multiple", F.col("loo_n").alias("n"), "q_low", "q_high", F.col("loo_median").alias("trimmed_median"))
    return rounded(out, 5)


@query("va10_comparables")
def _(t):
    df = inputs(t).withColumns({"forward_pe": N.div("close_raw", "forward_eps"), "forward_earnings": F.col("forward_eps") * F.col("shares")})
    return rounded(V.comparables(df), 4)


fragment("qa", """SELECT a.company_id, a.date, a.growth AS sg, a.margin AS sm, count(b.growth) AS ng, median(b.growth) AS mg, stddev_pop(b.growth) AS dg, count(b.margin) AS nm, median(b.margin) AS mm, stddev_pop(b.margin) AS dm
   FROM pk a JOIN pk b ON a.date = b.date AND a.company_id <> b.company_id AND CASE a.pkind WHEN 'industry' THEN a.industry = b.industry ELSE a.sector = b.sector END GROUP BY 1, 2, 3, 4""", "pk")


@query("va11_quality_adjustment", f"""{{{{with qa}}}} SELECT company_id, date, {R('''greatest(least(
   CASE WHEN ng >= 5 AND sg IS NOT NULL THEN 0.10 * greatest(least((sg - mg) / greatest(CASE WHEN dg > 1e-9 THEN dg ELSE 0.05 END, 0.01), 2), -2) ELSE 0 END + CASE WHEN nm >= 5 AND sm IS NOT NULL THEN 0.08 * greatest(least((sm - mm) / greatest(CASE WHEN dm > 1e-9 THEN dm ELSE 0.03 END, 0.01), 2), -2) ELSE 0 END, 0.3), -0.3)''', 5)} AS adjustment FROM qa""")
def _(t):
    df = V.choose_peer_group(cut_lineage(inputs(t)))
    return rounded(V.quality_adjustment(df).select("company_id", "date", "adjustment"), 5)


fragment("oh", """SELECT company_id, multiple, any_value(n) AS observations, median(x) AS typical FROM (SELECT *, count(*) OVER g AS n, quantile_cont(x, 0.1) OVER g AS a, quantile_cont(x, 0.9) OVER g AS b FROM (
   SELECT company_id, 'ev_ebit' AS multiple, ev_ebit AS x FROM vi WHERE ev_ebit > 0 UNION ALL SELECT company_id, 'trailing_pe', trailing_pe FROM vi WHERE trailing_pe > 0) WINDOW g AS (PARTITION BY company_id, multiple)) WHERE n < 5 OR x BETWEEN a AND b GROUP BY 1, 2""", "vi")


@query("ag9_trimmed_median", f"{{{{with oh}}}} SELECT company_id, multiple, observations, {R('typical', 5)} AS typical FROM oh WHERE observations >= 10")
def _(t):
    return rounded(V.own_history(inputs(t), ["ev_ebit", "trailing_pe"], min_observations=10).select("company_id", "multiple", "observations", "typical"), 5)


@query("va12_historical", f"""{{{{with oh}}}}, l AS (SELECT * FROM vi QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY date DESC) = 1), c AS (SELECT company_id, multiple, typical, CASE multiple WHEN 'ev_ebit' THEN CASE WHEN ebit > 0 THEN typical * ebit - coalesce(net_debt, 0) - coalesce(minority_interest, 0) - coalesce(preferred_equity, 0) END
   ELSE CASE WHEN net_income > 0 THEN typical * net_income END END / shares AS v FROM oh JOIN l USING (company_id) WHERE observations >= 10)
   SELECT company_id, multiple, {R('v', 4)} AS value_per_share FROM c WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY multiple) = 1""")
def _(t):
    df = cut_lineage(inputs(t).withColumn("forward_earnings", F.col("forward_eps") * F.col("shares")))
    last = df.groupBy("company_id").agg(F.max_by(F.struct(*[c for c in df.columns if c != "company_id"]), "date").alias("_r")).select("company_id", "_r.*")
    return rounded(V.historical(last, V.own_history(df, ["ev_ebit", "trailing_pe"], min_observations=10)).select("company_id", "multiple", "value_per_share"), 4)


@query("va2_own_medians", f"{{{{with fm3}}}} SELECT company_id, {R('median(operating_margin)')} AS historical_margin, {R('median(revenue_growth_1y)')} AS historical_growth, count(operating_margin) AS n_margins FROM fm3 GROUP BY 1")
def _(t):
    return rounded(V.own_medians(strength(t)))


_RI = "(1 + " + " + ".join(f"pow(1.02, {t - 1}) * (greatest(least(roe, 0.4), -0.3) - c) * {1 - (t - 1) / 10} / pow(1 + c, {t})" for t in range(1, 11)) + ")"


@query("va13_residual_income", f"{{{{with fm4}}}}, k AS (SELECT *, {_COE.format(x='0')} AS c FROM (SELECT *, 0.8 + cik % 7 * 0.25 AS beta FROM fm4)) SELECT company_id, date, {R('CASE WHEN equity > 0 AND shares_current_basis > 0 AND roe IS NOT NULL THEN equity * ' + _RI + ' / shares_current_basis END', 4)} AS value FROM k")
def _(t):
    coe = V.cost_of_equity("beta", F.lit(V.RISK_FREE), "market_cap")
    return rounded(inputs(t).select("company_id", "date", V.residual_income(F.col("equity"), F.col("roe"), coe, F.col("shares")).alias("value")), 4)


@query("va14_reit", f"""{{{{with fm1}}}}, a AS (SELECT *, net_income + depreciation_amortization AS ffo, net_income + depreciation_amortization - capex AS affo FROM fm1)
   SELECT company_id, date, {R('CASE WHEN affo > 0 AND shares_current_basis > 0 THEN CASE WHEN ffo / 0.055 - net_debt > 0 THEN 0.6 * affo * 18 + 0.4 * (ffo / 0.055 - net_debt) ELSE affo * 18 END / shares_current_basis END', 4)} AS value FROM a""")
def _(t):
    df = FM.add_building_blocks(company_panel(t)).withColumns({"depreciation": F.col("depreciation_amortization"), "shares": F.col("shares_current_basis")})
    return rounded(df.select("company_id", "date", V.reit_value().alias("value")), 4)


@query("va15_normalised", f"""{{{{with fm3}}}}, m AS (SELECT company_id, median(operating_margin) AS hm, count(operating_margin) AS k FROM fm3 GROUP BY 1), v AS (SELECT *, revenue * coalesce(CASE WHEN k >= 8 THEN hm END, operating_margin) AS e FROM fm3 JOIN m USING (company_id))
   SELECT company_id, date, {R('CASE WHEN shares_current_basis > 0 AND revenue > 0 AND e > 0 THEN (e * 12 - coalesce(net_debt, 0)) / shares_current_basis END', 4)} AS value FROM v""")
def _(t):
    df = cut_lineage(strength(t).withColumn("shares", F.col("shares_current_basis")))
    return rounded(df.join(V.own_medians(df), "company_id").select("company_id", "date", V.normalised_value().alias("value")), 4)


fragment("me", """SELECT company_id, price, business_model, m.method, m.value, m.w, m.halve FROM (SELECT *, unnest([{'method': 'dcf', 'value': price * (0.7 + cik % 9 * 0.1), 'w': CASE business_model WHEN 'operating' THEN 0.5 WHEN 'cyclical' THEN 0.2 WHEN 'unprofitable_growth' THEN 0.6 END, 'halve': false},
   {'method': 'comparables', 'value': price * (0.5 + cik % 5 * 0.3), 'w': CASE business_model WHEN 'unprofitable_growth' THEN 0.4 WHEN 'cyclical' THEN 0.2 WHEN 'reit' THEN 0.25 ELSE 0.3 END, 'halve': false},
   {'method': 'historical', 'value': price * (0.01 + cik % 4 * 0.6), 'w': CASE business_model WHEN 'operating' THEN 0.2 WHEN 'bank' THEN 0.25 WHEN 'reit' THEN 0.25 WHEN 'cyclical' THEN 0.2 END, 'halve': cik % 3 = 0}]) AS m
   FROM (SELECT * FROM vi QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY date DESC) = 1))""", "vi")
fragment("bl", """SELECT company_id, any_value(price) AS price, any_value(business_model) AS business_model, count(*) AS n_methods, sum(value * w) / sum(w) AS base, CASE WHEN count(*) > 1 THEN stddev_pop(value) / abs(sum(value * w) / sum(w)) END AS dispersion, min(value) AS mn, max(value) AS mx, bool_or(method = 'dcf') AS du
   FROM (SELECT * REPLACE (w * CASE WHEN halve THEN 0.5 ELSE 1 END AS w) FROM me) WHERE w IS NOT NULL AND value / price BETWEEN 0.05 AND 10 GROUP BY 1""", "me")
fragment("bv", """SELECT *, least(least(CASE WHEN n_methods > 1 THEN mn ELSE base END, base), CASE WHEN du THEN base * 0.8 ELSE base * (1 - bd) END) AS bear, greatest(greatest(CASE WHEN n_methods > 1 THEN mx ELSE base END, base), CASE WHEN du THEN base * 1.3 ELSE base * (1 + bd) END) AS bull
   FROM (SELECT *, least(greatest(coalesce(dispersion, 0), CASE WHEN n_methods > 1 THEN 0.2 ELSE 0.35 END), 0.6) AS bd FROM bl)""", "bl")


def blended(t: Tables):
    df = cut_lineage(inputs(t))
    last = df.groupBy("company_id").agg(F.max_by(F.struct("price", "business_model", "cik"), "date").alias("_r")).select("company_id", "_r.*")
    price, k = F.col("price"), F.col("cik")
    row = lambda m, v, h: F.struct(F.lit(m).alias("method"), v.alias("value"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(True).alias("usable"), h.alias("halve"))
    rows = last.withColumn("_m", F.explode(F.array(row("dcf", price * (0.7 + k % 9 * 0.1), F.lit(False)), row("comparables", price * (0.5 + k % 5 * 0.3), F.lit(False)), row("historical", price * (0.01 + k % 4 * 0.6), k % 3 == 0)))).select("company_id", "_m.*")
    companies = last.withColumns({"dcf_base": F.lit(10.0), "dcf_bear": F.lit(8.0), "dcf_bull": F.lit(13.0)})
    return V.blend(rows, companies)


_BL = ["base", "dispersion", "bear", "bull"]


@query("va16_blend", "{{with bv}} " + round_sql("SELECT * FROM bv", ["company_id", "n_methods", *_BL], _BL))
def _(t):
    return rounded(blended(t).select("company_id", "n_methods", *_BL))


@query("va17_classify", """{{with bv}}, c AS (SELECT *, base / price - 1 AS up, greatest(least((bull - bear) / abs(base) / 0.6, 2), 0.5) AS w FROM bv) SELECT company_id, CASE WHEN up >= 0.3 * w THEN 'significantly_undervalued' WHEN up >= 0.12 * w THEN 'undervalued' WHEN up <= -0.3 * w THEN 'significantly_overvalued' WHEN up <= -0.12 * w THEN 'overvalued' ELSE 'fairly_valued' END AS classification FROM c""")
def _(t):
    return blended(t).withColumn("confidence", F.lit(0.5)).select("company_id", V.classify().alias("classification"))


fragment("vcf", """SELECT *, (bull - bear) / abs(base) AS wd FROM bv""", "bv")


@query("va18_valuation_confidence", f"""{{{{with vcf}}}} SELECT company_id, {R('''CASE WHEN n_methods = 1 THEN 0.7 WHEN dispersion IS NULL THEN 0.7 WHEN dispersion > 0.5 THEN 0.55 WHEN dispersion > 0.25 THEN 0.8 ELSE 1 END * CASE WHEN wd > 1.5 THEN 0.5 WHEN wd > 1 THEN 0.7 WHEN wd > 0.7 THEN 0.88 ELSE 1 END * 0.8 * 0.88 * 0.85 * 0.8 * 0.9
   * CASE business_model WHEN 'unprofitable_growth' THEN 0.65 WHEN 'cyclical' THEN 0.85 ELSE 1 END''')} AS confidence FROM vcf""")
def _(t):
    df = blended(t).withColumns({"worst_swing": F.lit(0.6), "terminal_share": F.lit(0.82), "has_dcf": F.lit(True), "metric_coverage": F.lit(0.6), "data_age_days": F.lit(140), "n_analysts": F.lit(4)})
    return rounded(df.select("company_id", V.valuation_confidence().alias("confidence")))


@query("va19_caveats", """{{with bv}} SELECT company_id, array_to_string(list_filter([CASE WHEN n_methods = 1 THEN 'only one method' END, CASE WHEN dispersion > 0.25 THEN 'methods disagree' END, CASE WHEN NOT du THEN 'generic range' END, CASE WHEN business_model = 'cyclical' THEN 'cyclical earnings' END, CASE WHEN business_model = 'unprofitable_growth' THEN 'not yet profitable' END], lambda x: x IS NOT NULL), '; ') AS caveats FROM bv""")
def _(t):
    df = blended(t).withColumn("data_age_days", F.lit(10))
    return df.select("company_id", F.array_join(V.valuation_caveats(), "; ").alias("caveats"))


@query("fm5_financial_metrics")
def _(t):
    """The composed build: month grid, as-of facts, share basis, every metric."""
    from panelstone.operators.calendar import month_end_sessions
    from panelstone.operators.prices import add_split_factor
    prices = cut_lineage(add_split_factor(t.prices))
    grid = FM.build_grid(prices, t.companies, month_end_sessions(t.sessions))
    facts = facts_long(t, list(CONCEPT_SQL))
    missing = [c for c in FM.CONCEPTS if c not in CONCEPT_SQL]
    panel = cut_lineage(FM.attach_share_basis(FM.attach_fundamentals(grid, facts, list(CONCEPT_SQL)), prices))
    panel = panel.withColumns({c: F.lit(None).cast("double") for c in missing})
    out = FM.add_valuation(FM.add_growth(cut_lineage(FM.add_quality(FM.add_building_blocks(panel)))))
    return rounded(out.select("company_id", "date", "roic", "gross_margin", "revenue_growth_1y", "ev_ebit", "valuation_vs_history", "market_cap"), 5)
