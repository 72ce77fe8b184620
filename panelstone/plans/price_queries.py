"""Price reshaping, rolling price and risk metrics, grids and calendars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelstone.functions.numeric import rd
from panelstone.operators import calendar as cal
from panelstone.operators import prices as P
from panelstone.operators.asof import horizon_returns
from panelstone.operators.rolling import Roll, max_drawdown_running, rolling, rolling_drawdown, rolling_median
from panelstone.plans.base import MARKET, R, Tables, fragment, query, rounded
from panelstone.session import dealt, stacked

fragment("pxm", """SELECT px.*, mk.close AS mkt_close, sf.close AS sector_close FROM px LEFT JOIN mk USING (date)
   JOIN co USING (ticker) LEFT JOIN sf ON sf.sector = co.sector AND sf.date = px.date""", "px", "mk", "sf", "co")
fragment("mkr", "SELECT date, close AS mkt_close, close / lag(close) OVER (ORDER BY date) - 1 AS mkt_ret FROM mk", "mk")
fragment("rets", """SELECT px.*, close_adj / lag(close_adj) OVER w - 1 AS ret_1d, mkt_ret, mkt_close, row_number() OVER w AS rn
   FROM px LEFT JOIN mkr USING (date) WINDOW w AS (PARTITION BY ticker ORDER BY date)""", "px", "mkr")


def with_returns(t: Tables):
    df = dealt(P.with_market(t.prices.transform(stacked, t.market), MARKET), "ticker")
    return df.withColumn("ret_1d", F.col("close_adj") / F.lag("close_adj", 1).over(Window.partitionBy("ticker").orderBy("date")) - 1.0)


@query("ing7_wide_to_long", f"""SELECT date, ticker, {R('close')} AS close FROM (
   SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS ticker, avg(l_quantity) AS close FROM lineitem GROUP BY 1, 2) WHERE close > 0""")
def _(t):
    wide = t.raw("lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(
        *[F.avg(F.when(F.col("l_returnflag") == x, F.col("l_quantity"))).alias(x) for x in "ANR"])
    return rounded(P.wide_to_long(wide, "date", list("ANR")))


@query("ing7_clean_bars", f"""SELECT ticker, date, {R('close')} AS close FROM (
   SELECT 'T' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, l_quantity - 10 AS close, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)
   WHERE close > 0 QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY seq DESC) = 1""")
def _(t):
    bars = t.raw("lineitem").select(
        F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("ticker"), F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_quantity") - 10).alias("close"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return rounded(P.clean_bars(bars, "seq").select("ticker", "date", "close"))


@query("ing8_split_factor", f"""{{{{with px}}}} SELECT ticker, date, {R('exp(total - coalesce(cum, 0))')} AS split_factor FROM (
   SELECT ticker, date, sum(lr) OVER (PARTITION BY ticker) AS total, sum(lr) OVER (PARTITION BY ticker ORDER BY date) AS cum
   FROM (SELECT ticker, date, ln(coalesce(split_ratio, 1.0)) AS lr FROM px))""")
def _(t):
    return rounded(P.add_split_factor(t.prices).select("ticker", "date", "split_factor"))


@query("ing9_dollar_volume", f"{{{{with px}}}} SELECT ticker, date, {R('close_raw * volume')} AS dollar_volume FROM px")
def _(t):
    return rounded(P.add_dollar_volume(t.prices.drop("dollar_volume")).select("ticker", "date", "dollar_volume"))


@query("ing10_sessions", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem")
def _(t):
    return cal.sessions(t.prices.transform(stacked, t.market), MARKET)


@query("ing11_median_dollar_volume", f"""{{{{with px}}}} SELECT ticker, {R('median(dollar_volume)')} AS median_dollar_volume FROM px
   WHERE date > (SELECT max(date) FROM px) - 200 GROUP BY 1""")
def _(t):
    return rounded(P.recent_median_dollar_volume(t.prices, 100))


@query("ing2_next_session", """{{with mk}}, ev AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + 400 AS d FROM orders),
   cal AS (SELECT date AS s FROM mk), last AS (SELECT max(s) AS m FROM cal)
   SELECT o_orderkey, d AS date, coalesce((SELECT min(s) FROM cal WHERE s > d),
     d + CASE dayofweek(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END) AS next_session FROM ev""")
def _(t):
    ev = t.raw("orders").select("o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), 400).alias("date"))
    return cal.next_session(ev, t.sessions, "date")


@query("wn1_ret_1d", f"{{{{with rets}}}} SELECT ticker, date, {R('ret_1d')} AS ret_1d FROM rets")
def _(t):
    return rounded(with_returns(t).select("ticker", "date", "ret_1d"))


@query("wn2_momentum", f"""{{{{with px}}}} SELECT ticker, date, {R('lag(close_adj, 21) OVER w / lag(close_adj, 252) OVER w - 1')} AS mom_12_1,
   {R('lag(close_adj, 21) OVER w / lag(close_adj, 126) OVER w - 1')} AS mom_6_1 FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
def _(t):
    return rounded(P.add_returns(t.prices).select("ticker", "date", "mom_12_1", "mom_6_1"))


@query("wn3_trailing_returns", f"""{{{{with px}}}} SELECT ticker, date, {R('close_adj / lag(close_adj, 63) OVER w - 1')} AS ret_3m,
   {R('close_adj / lag(close_adj, 126) OVER w - 1')} AS ret_6m, {R('close_adj / lag(close_adj, 252) OVER w - 1')} AS ret_12m
   FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
def _(t):
    return rounded(P.add_returns(t.prices).select("ticker", "date", "ret_3m", "ret_6m", "ret_12m"))


@query("wn4_relative_strength", f"""{{{{with pxm}}}} SELECT ticker, date,
   {R('close_adj / lag(close_adj, 126) OVER w - mkt_close / lag(mkt_close, 126) OVER w')} AS rel_strength_spy,
   {R('close_adj / lag(close_adj, 126) OVER w - sector_close / lag(sector_close, 126) OVER w')} AS rel_strength_sector
   FROM pxm WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
def _(t):
    df = P.with_market(t.all_prices, MARKET, t.companies, t.fund_map)
    return rounded(P.add_relative_strength(P.add_returns(df)).select("ticker", "date", "rel_strength_spy", "rel_strength_sector"))


@query("wn5_trend", f"""{{{{with px}}}}, m AS (SELECT ticker, date, close_adj, row_number() OVER w AS rn,
     avg(close_adj) OVER (w ROWS 49 PRECEDING) AS ma50, avg(close_adj) OVER (w ROWS 199 PRECEDING) AS ma200,
     max(close_adj) OVER (w ROWS 251 PRECEDING) AS hi FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)),
   g AS (SELECT ticker, date, close_adj, CASE WHEN rn >= 50 THEN ma50 END AS ma50, CASE WHEN rn >= 200 THEN ma200 END AS ma200,
     CASE WHEN rn >= 252 THEN hi END AS hi FROM m)
   SELECT ticker, date, {R('close_adj / ma50 - 1')} AS px_over_ma50, {R('close_adj / ma200 - 1')} AS px_over_ma200,
   {R('close_adj / hi - 1')} AS near_52w_high,
   {R('ma200 / lag(ma200, 63) OVER (PARTITION BY ticker ORDER BY date) - 1')} AS ma200_slope FROM g""")
def _(t):
    return rounded(P.add_trend(dealt(t.prices, "ticker")).select("ticker", "date", "px_over_ma50", "px_over_ma200", "near_52w_high", "ma200_slope"))


@query("wn6_momentum_consistency", f"""{{{{with rets}}}}, e AS (SELECT ticker, date,
     CASE WHEN count(ret_1d - mkt_ret) OVER w21 = 21 THEN sum(ret_1d - mkt_ret) OVER w21 END AS ex
     FROM rets WINDOW w21 AS (PARTITION BY ticker ORDER BY date ROWS 20 PRECEDING))
   SELECT ticker, date, {R("CASE WHEN count(ex) OVER w >= 126 THEN avg(CASE WHEN ex > 0 THEN 1.0 WHEN ex <= 0 THEN 0.0 END) OVER w END")} AS momentum_consistency
   FROM e WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING)""")
def _(t):
    return rounded(P.add_consistency(with_returns(t)).select("ticker", "date", "momentum_consistency"))


def _risk(t, *names):
    specs = [s for s in P.risk_rolls() if s.name in names]
    return rounded(rolling(with_returns(t), ["ticker"], "date", specs).select("ticker", "date", *names))


@query("wn7_volatility", f"""{{{{with rets}}}} SELECT ticker, date,
   {R("CASE WHEN count(ret_1d) OVER y >= 120 THEN stddev_samp(ret_1d) OVER y * sqrt(252) END")} AS volatility,
   {R("CASE WHEN count(ret_1d) OVER q >= 40 THEN stddev_samp(ret_1d) OVER q * sqrt(252) END")} AS volatility_3m
   FROM rets WINDOW y AS (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING), q AS (PARTITION BY ticker ORDER BY date ROWS 62 PRECEDING)""")
def _(t):
    return _risk(t, "volatility", "volatility_3m")


@query("wn8_dollar_volume_median", f"""{{{{with px}}}} SELECT ticker, date,
   {R("CASE WHEN count(dollar_volume) OVER w >= 20 THEN median(dollar_volume) OVER w END")} AS dollar_volume_median
   FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING)""")
def _(t):
    return rounded(t.prices.select("ticker", "date", rolling_median("dollar_volume", ["ticker"], "date", 60, 20).alias("dollar_volume_median")))


_DRAWDOWN = """CASE WHEN rn >= 63 THEN list_reduce(list_transform(l, lambda x: {'p': x, 'd': 0.0}),
   lambda a, x: {'p': greatest(a.p, x.p), 'd': least(a.d, x.p / greatest(a.p, x.p) - 1)}).d END"""


@query("wn9_max_drawdown", f"""{{{{with rets}}}}, w AS (SELECT ticker, date, rn,
     list(close_adj) OVER (PARTITION BY ticker ORDER BY date ROWS 62 PRECEDING) AS l FROM rets)
   SELECT ticker, date, {R(_DRAWDOWN)} AS max_drawdown FROM w""")
def _(t):
    return rounded(rolling_drawdown(t.prices, ["ticker"], "date", "close_adj", 63, "max_drawdown").select("ticker", "date", "max_drawdown"))


@query("wn10_downside_deviation", f"""{{{{with rets}}}} SELECT ticker, date, {R('''CASE WHEN rn >= 252 AND count(ret_1d) OVER w >= 40
   THEN sqrt(sum(least(ret_1d, 0) * least(ret_1d, 0)) FILTER (ret_1d IS NOT NULL) OVER w / count(ret_1d) OVER w) * sqrt(252) END''')} AS downside_deviation
   FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING)""")
def _(t):
    return _risk(t, "downside_deviation")


def _beta_specs():
    r, m = F.col("ret_1d"), F.col("mkt_ret")
    return [
        Roll("beta_raw", "beta", r, 252, 120, y=m, full=True),
        Roll("downside_beta", "beta", F.when(m < 0, r), 252, 40, y=F.when(m < 0, m), full=True),
    ]


@query("wn11_downside_beta", f"""{{{{with rets}}}}, d AS (SELECT ticker, date, rn, CASE WHEN mkt_ret < 0 AND ret_1d IS NOT NULL THEN ret_1d END AS r,
     CASE WHEN mkt_ret < 0 AND ret_1d IS NOT NULL THEN mkt_ret END AS m FROM rets)
   SELECT ticker, date, {R("CASE WHEN rn >= 252 AND count(r) OVER w >= 40 AND var_pop(m) OVER w > 1e-12 THEN covar_pop(r, m) OVER w / var_pop(m) OVER w END")} AS downside_beta
   FROM d WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING)""")
def _(t):
    return rounded(rolling(with_returns(t), ["ticker"], "date", _beta_specs()).select("ticker", "date", "downside_beta"))


@query("wn12_amihud", f"""{{{{with rets}}}}, d AS (SELECT ticker, date, rn, CASE WHEN dollar_volume > 0 THEN abs(ret_1d) / dollar_volume * 1e6 END AS x FROM rets)
   SELECT ticker, date, {R("CASE WHEN rn >= 63 AND count(x) OVER w >= 40 THEN avg(x) OVER w END")} AS amihud
   FROM d WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 62 PRECEDING)""")
def _(t):
    specs = [s for s in P.risk_rolls() if s.name == "amihud"]
    return rounded(rolling(with_returns(t), ["ticker"], "date", specs).select("ticker", "date", "amihud"))


@query("wn13_beta", f"""{{{{with rets}}}}, d AS (SELECT ticker, date, rn, CASE WHEN mkt_ret IS NOT NULL THEN ret_1d END AS r, CASE WHEN ret_1d IS NOT NULL THEN mkt_ret END AS m FROM rets),
   b AS (SELECT ticker, date, CASE WHEN rn >= 252 AND count(r) OVER w >= 120 AND var_pop(m) OVER w > 1e-12 THEN covar_pop(r, m) OVER w / var_pop(m) OVER w END AS beta_raw
   FROM d WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING))
   SELECT ticker, date, {R('beta_raw')} AS beta_raw, {R('0.67 * beta_raw + 0.33')} AS beta FROM b""")
def _(t):
    df = rolling(with_returns(t), ["ticker"], "date", _beta_specs())
    return rounded(df.select("ticker", "date", "beta_raw", (P.BLUME * F.col("beta_raw") + (1 - P.BLUME)).alias("beta")))


@query("wn28_running_drawdown", f"{{{{with px}}}} SELECT ticker, date, {R('close_adj / max(close_adj) OVER (PARTITION BY ticker ORDER BY date) - 1')} AS drawdown FROM px")
def _(t):
    return rounded(max_drawdown_running(t.prices, ["ticker"], "date", "close_adj", "drawdown").select("ticker", "date", "drawdown"))


@query("price_metrics_full")
def _(t):
    t.keep_funds()
    return P.build_price_metrics(t.all_prices, MARKET, t.companies, t.fund_map)


# ---- grids and calendars


@query("grd1_date_grid", """{{with mk}}, d AS (SELECT date, max(date) OVER () AS e FROM mk),
   k AS (SELECT date, e, max(date) OVER (PARTITION BY isoyear(date), week(date)) AS l FROM d WHERE date >= e - 365 * 3)
   SELECT date FROM k WHERE date = l OR date >= e - 30""")
def _(t):
    return cal.week_and_recent_grid(t.sessions, 3, 30)


@query("grd2_month_end_sessions", "SELECT max(CAST(l_shipdate AS DATE)) AS date FROM lineitem WHERE l_shipdate BETWEEN DATE '1996-02-10' AND DATE '1999-06-20' GROUP BY date_trunc('month', l_shipdate)")
def _(t):
    return cal.month_end_sessions(t.sessions, "1996-02-10", "1999-06-20")


@query("grd3_month_ends", """SELECT CAST(last_day(m) AS DATE) AS date FROM (SELECT unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS m, a, b
   FROM (SELECT min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem)) WHERE last_day(m) BETWEEN a AND b""")
def _(t):
    bounds = t.raw("lineitem").agg(F.min(F.col("l_shipdate").cast("date")).alias("start"), F.max(F.col("l_shipdate").cast("date")).alias("end"))
    return cal.month_ends(bounds)


@query("grd4_shift_dates", """{{with mk, mend}}, i AS (SELECT date, row_number() OVER (ORDER BY date) AS r FROM mk)
   SELECT DISTINCT b.date FROM mend m JOIN i a ON a.date = m.date JOIN i b ON b.r = a.r + 5""")
def _(t):
    return cal.shift_dates(cal.month_end_sessions(t.sessions), t.sessions, 5)


@query("grd5_grid", f"""{{{{with px, co, mend}}}} SELECT company_id, ticker, date, {R('close_raw')} AS close_raw FROM px JOIN co USING (ticker) WHERE date IN (SELECT date FROM mend)""")
def _(t):
    from panelstone.operators.financial import build_grid
    grid = build_grid(P.add_split_factor(t.prices), t.companies, cal.month_end_sessions(t.sessions))
    return rounded(grid.select("company_id", "ticker", "date", "close_raw"))


@query("grd6_predicates", f"""{{{{with px}}}} SELECT ticker, date, {R('volume')} AS volume FROM px WHERE ticker IN ('T1','T2','T3') AND close_raw BETWEEN 40 AND 50 AND split_ratio IS NOT NULL""")
def _(t):
    c = F.col
    return rounded(t.prices.where(c("ticker").isin("T1", "T2", "T3") & c("close_raw").between(40, 50) & c("split_ratio").isNotNull()).select("ticker", "date", "volume"))


@query("grd9_latest_session", "SELECT max(CAST(l_shipdate AS DATE)) AS date FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '1999-07-14'")
def _(t):
    return cal.latest_session(t.sessions, F.lit("1999-07-15").cast("date"), F.lit(True))


@query("grd10_latest_date", "SELECT max(CAST(o_orderdate AS DATE)) AS date FROM orders")
def _(t):
    return t.raw("orders").agg(F.max(F.col("o_orderdate").cast("date")).alias("date"))


@query("jn14_horizon_returns", f"""{{{{with px, mk, mend}}}}, i AS (SELECT date, row_number() OVER (ORDER BY date) AS r FROM mk),
   b AS (SELECT p.ticker, p.date, p.close_adj AS p0, m0.close AS m0, r FROM px p JOIN mend e ON e.date = p.date JOIN i ON i.date = p.date JOIN mk m0 ON m0.date = p.date)
   SELECT b.ticker, b.date, {R('p1.close_adj / p0 - 1')} AS fwd_1m, {R('p1.close_adj / p0 - 1 - (m1.close / m0 - 1)')} AS excess_1m,
     {R('p3.close_adj / p0 - 1')} AS fwd_3m, {R('p3.close_adj / p0 - 1 - (m3.close / m0 - 1)')} AS excess_3m
   FROM b LEFT JOIN i i1 ON i1.r = b.r + 21 LEFT JOIN px p1 ON p1.ticker = b.ticker AND p1.date = i1.date LEFT JOIN mk m1 ON m1.date = i1.date
   LEFT JOIN i i3 ON i3.r = b.r + 63 LEFT JOIN px p3 ON p3.ticker = b.ticker AND p3.date = i3.date LEFT JOIN mk m3 ON m3.date = i3.date""")
def _(t):
    every = t.prices.transform(stacked, t.market)
    decisions = t.prices.join(F.broadcast(cal.month_end_sessions(t.sessions)), "date", "left_semi").select("ticker", "date")
    return rounded(horizon_returns(decisions, every, t.sessions, [1, 3], MARKET))
