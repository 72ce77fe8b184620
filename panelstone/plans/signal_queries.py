"""Technical features, signal-store features and rolling regressions over the price proxy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelstone.operators import evaluate as E
from panelstone.operators import prices as P
from panelstone.operators import signals as G
from panelstone.operators.rolling import Roll, compound, forward_fill, rolling
from panelstone.plans.base import MARKET, R, Tables, fragment, query, round_sql, rounded
from panelstone.session import stacked

fragment("tb", """SELECT px.ticker, px.date, close_adj AS close, dollar_volume, volume, mkt_ret, close_adj / lag(close_adj) OVER w - 1 AS ret_1d, row_number() OVER w AS rn FROM px LEFT JOIN mkr USING (date) WINDOW w AS (PARTITION BY ticker ORDER BY date)""", "px", "mkr")


def _full(agg, x, n, w):
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {agg}({x}) OVER {w} END"


def _w(n):
    return f"(PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING)"


fragment("tf", f"""SELECT *, ret_1d - beta_252d * mkt_ret AS resid FROM (SELECT *, {_full('avg', 'close', 50, _w(50))} AS ma50, {_full('avg', 'close', 200, _w(200))} AS ma200, {_full('max', 'close', 252, _w(252))} AS hi,
   {_full('avg', 'up', 63, _w(63))} AS up_day_ratio, {_full('stddev_samp', 'ret_1d', 63, _w(63))} * sqrt(252) AS vol_63d, CASE WHEN count(neg) OVER {_w(126)} >= 20 THEN stddev_samp(neg) OVER {_w(126)} * sqrt(252) END AS downside_vol_126d,
   ({_full('avg', 'rm', 252, _w(252))} - {_full('avg', 'ret_1d', 252, _w(252))} * {_full('avg', 'mkt_ret', 252, _w(252))}) / ({_full('avg', 'mm', 252, _w(252))} - {_full('avg', 'mkt_ret', 252, _w(252))} * {_full('avg', 'mkt_ret', 252, _w(252))} + 1e-12) AS beta_252d,
   {_full('avg', 'ill', 63, _w(63))} AS amihud_illiq, {_full('avg', 'dollar_volume', 21, _w(21))} / {_full('avg', 'dollar_volume', 252, _w(252))} - 1 AS volume_trend, ln(CASE WHEN count(*) OVER {_w(21)} = 21 THEN median(dollar_volume) OVER {_w(21)} END + 1) AS log_dollar_volume
   FROM (SELECT *, CASE WHEN ret_1d > 0 THEN 1.0 WHEN ret_1d <= 0 THEN 0.0 END AS up, CASE WHEN ret_1d < 0 THEN ret_1d END AS neg, ret_1d * mkt_ret AS rm, CASE WHEN mkt_ret IS NOT NULL THEN mkt_ret * mkt_ret END AS mm, abs(ret_1d) / (dollar_volume + 1e-12) * 1e9 AS ill FROM tb))""", "tb")
fragment("tg", f"""SELECT ticker, date, up_day_ratio, vol_63d, downside_vol_126d, beta_252d, amihud_illiq, volume_trend, log_dollar_volume, ma50 / (ma200 + 1e-12) - 1 AS ma_50_200, near_52w_high, {_full('stddev_samp', 'resid', 126, _w(126))} * sqrt(252) AS idio_vol_126d,
   {_full('sum', 'resid', 126, _w(126))} - {_full('sum', 'resid', 21, _w(21))} AS resid_mom_126d, {_full('min', 'near_52w_high', 252, _w(252))} AS max_drawdown_252d FROM (SELECT *, close / (hi + 1e-12) - 1 AS near_52w_high FROM tf)""", "tf")


def technical(t: Tables):
    df = P.with_market(t.prices.transform(stacked, t.market), MARKET).withColumn("close", F.col("close_adj"))
    return G.technical_features(df)


def _tech(name, cols, digits=5):
    @query(name, "{{with tg}} " + round_sql("SELECT * FROM tg", ["ticker", "date", *cols], cols, digits))
    def _(t):
        return rounded(technical(t).select("ticker", "date", *cols), digits)


_tech("wn17_older_drawdown", ["near_52w_high", "max_drawdown_252d"])
_tech("wn18_trend_and_volatility", ["up_day_ratio", "ma_50_200", "vol_63d", "downside_vol_126d"])
_tech("wn19_beta_moments", ["beta_252d"], 4)
_tech("wn20_residuals", ["idio_vol_126d", "resid_mom_126d"], 3)
_tech("wn21_liquidity", ["log_dollar_volume", "amihud_illiq", "volume_trend"], 2)

fragment("st", "SELECT ticker AS entity, date AS dt, close_adj AS close, volume, 0.03 + volume / 1e4 AS rv_range_close, close_adj / lag(close_adj) OVER w - 1 AS ret_1d FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)", "px")


def _e(n):
    return f"(PARTITION BY entity ORDER BY dt ROWS {n - 1} PRECEDING)"


fragment("sm", f"""SELECT *, {_full('avg', 'macd', 9, _e(9))} AS macd_signal FROM (SELECT *, ema12 - ema26 AS macd, 100 - 100 / (1 + g / (l + 1e-12)) AS rsi14 FROM (SELECT *, {_full('avg', 'close', 12, _e(12))} AS ema12, {_full('avg', 'close', 26, _e(26))} AS ema26, {_full('avg', 'gain', 14, _e(14))} AS g, {_full('avg', 'loss', 14, _e(14))} AS l,
   close / lag(close, 20) OVER (PARTITION BY entity ORDER BY dt) - 1 AS ret_20d, close / lag(close, 180) OVER (PARTITION BY entity ORDER BY dt) - 1 AS ret_180d, {_full('avg', 'close', 20, _e(20))} AS ma20, {_full('avg', 'close', 100, _e(100))} AS ma100, {_full('stddev_samp', 'ret_1d', 60, _e(60))} AS vol_cc_60, {_full('avg', 'rv_range_close', 60, _e(60))} AS rv_rc_60,
   volume / ({_full('avg', 'volume', 20, _e(20))} + 1e-12) - 1 AS vol_rel_20 FROM (SELECT *, CASE WHEN ret_1d > 0 THEN ret_1d ELSE 0 END AS gain, CASE WHEN ret_1d < 0 THEN -ret_1d ELSE 0 END AS loss FROM st)))""", "st")


def store_rows(t: Tables):
    return t.prices.select(F.col("ticker").alias("entity"), F.col("date").alias("dt"), F.col("close_adj").alias("close"), "volume", (F.lit(0.03) + F.col("volume") / 1e4).alias("rv_range_close"))


def _store(name, cols, sql_cols=None, digits=5):
    @query(name, "{{with sm}} SELECT entity, dt, " + ", ".join(f"{R(e, digits)} AS {c}" for c, e in zip(cols, sql_cols or cols)) + " FROM sm")
    def _(t):
        return rounded(G.signal_features(store_rows(t), date="dt").select("entity", "dt", *cols), digits)


_store("wn22_rsi", ["rsi14"], digits=4)
_store("wn23_macd", ["ema12", "ema26", "macd", "macd_signal", "macd_hist"], ["ema12", "ema26", "macd", "macd_signal", "macd - macd_signal"])
_store("wn24_signal_features", ["ret_20d", "ret_180d", "ma20", "ma100", "px_over_ma100", "vol_cc_60", "rv_rc_60", "vol_rel_20"], ["ret_20d", "ret_180d", "ma20", "ma100", "close / (ma100 + 1e-12) - 1", "vol_cc_60", "rv_rc_60", "vol_rel_20"])

fragment("rs", """SELECT st.*, sector, avg(ret_1d) OVER (PARTITION BY dt) AS mkt_ret_1d, avg(ret_1d) OVER (PARTITION BY dt, sector) AS sector_ret_1d FROM st JOIN co ON co.ticker = st.entity""", "st", "co")


def with_sectors(t: Tables):
    base = store_rows(t).join(t.companies.select(F.col("ticker").alias("entity"), "sector"), "entity")
    ret = F.try_divide("close", F.lag("close", 1).over(Window.partitionBy("entity").orderBy("dt"))) - 1.0
    return base.withColumn("ret_1d", ret)


@query("wn25_market_sector_returns", f"{{{{with rs}}}} SELECT entity, dt, {R('mkt_ret_1d')} AS mkt_ret_1d, {R('sector_ret_1d')} AS sector_ret_1d FROM rs")
def _(t):
    return rounded(G.add_market_sector_returns(with_sectors(t), "dt", sector="sector").select("entity", "dt", "mkt_ret_1d", "sector_ret_1d"))


fragment("ro", f"""SELECT *, c1 / (v11 + 1e-12) AS b1, (c1 * v22 - v12 * c2) / (v11 * v22 - v12 * v12 + 1e-18) AS b21, (c2 * v11 - v12 * c1) / (v11 * v22 - v12 * v12 + 1e-18) AS b22 FROM (SELECT *, {_full('avg', 'p11', 60, _e(60))} AS v11, {_full('avg', 'p1y', 60, _e(60))} AS c1, {_full('avg', 'p22', 60, _e(60))} AS v22, {_full('avg', 'p12', 60, _e(60))} AS v12, {_full('avg', 'p2y', 60, _e(60))} AS c2
   FROM (SELECT *, x1c * x1c AS p11, x1c * yc AS p1y, x2c * x2c AS p22, x1c * x2c AS p12, x2c * yc AS p2y FROM (SELECT *, ret_1d - yb AS yc, mkt_ret_1d - xb1 AS x1c, sector_ret_1d - xb2 AS x2c FROM (SELECT *, {_full('avg', 'ret_1d', 60, _e(60))} AS yb, {_full('avg', 'mkt_ret_1d', 60, _e(60))} AS xb1, {_full('avg', 'sector_ret_1d', 60, _e(60))} AS xb2 FROM rs))))""", "rs")


@query("wn26_rolling_regression_market", f"{{{{with ro}}}} SELECT entity, dt, {R('b1', 4)} AS beta_mkt_60d, {R('yb - b1 * xb1', 4)} AS alpha_60d, {R('ret_1d - (yb - b1 * xb1 + b1 * mkt_ret_1d)', 4)} AS resid_1d FROM ro")
def _(t):
    df = G.add_market_sector_returns(with_sectors(t), "dt", sector="sector")
    return rounded(G.rolling_regression(df, "entity", "dt").select("entity", "dt", "beta_mkt_60d", "alpha_60d", "resid_1d"), 4)


@query("wn26_rolling_regression_two_factor", f"{{{{with ro}}}} SELECT entity, dt, {R('b21', 3)} AS beta_mkt_60d, {R('b22', 3)} AS beta_sec_60d, {R('yb - b21 * xb1 - b22 * xb2', 3)} AS alpha_60d FROM ro")
def _(t):
    df = G.add_market_sector_returns(with_sectors(t), "dt", sector="sector")
    return rounded(G.rolling_regression(df, "entity", "dt", two_factor=True).select("entity", "dt", "beta_mkt_60d", "beta_sec_60d", "alpha_60d"), 3)


@query("wn27_forward_returns", f"""{{{{with st, co, mk}}}}, f AS (SELECT entity, dt, sector, ln(lead(close, 20) OVER w / close) AS r FROM st JOIN co ON co.ticker = entity WINDOW w AS (PARTITION BY entity ORDER BY dt)), m AS (SELECT date AS dt, ln(lead(close, 20) OVER (ORDER BY date) / close) AS mr FROM mk)
   SELECT entity, dt, {R('r')} AS fwd20_ret, {R('r - mr')} AS fwd20_ret_ex_mkt, {R('r - avg(r) OVER (PARTITION BY dt, sector)')} AS fwd20_ret_ex_sec FROM f LEFT JOIN m USING (dt)""")
def _(t):
    base = with_sectors(t).select("entity", "dt", "close", "sector")
    market = t.market.select(F.col("ticker").alias("entity"), F.col("date").alias("dt"), F.col("close_adj").alias("close"), F.lit("none").alias("sector"))
    out = G.forward_return(base.transform(stacked, market), 20, "entity", "dt", benchmark=MARKET, sector="sector")
    return rounded(out.where(F.col("entity") != MARKET).select("entity", "dt", "fwd20_ret", "fwd20_ret_ex_mkt", "fwd20_ret_ex_sec"))


@query("wn29_compound", f"{{{{with st}}}} SELECT entity, dt, {R('exp(sum(ln(1 + coalesce(ret_1d, 0))) OVER (PARTITION BY entity ORDER BY dt))', 4)} AS growth FROM st")
def _(t):
    return rounded(compound(with_sectors(t), ["entity"], "dt", "ret_1d", "growth").select("entity", "dt", "growth"), 4)


@query("wn30_expanding_bands", f"""{{{{with mk}}}}, e AS (SELECT max(date) AS date FROM mk GROUP BY date_trunc('month', date)), m AS (SELECT date, close FROM mk JOIN e USING (date)) SELECT date, {R('CASE WHEN count(close) OVER w >= 10 THEN quantile_cont(close, 0.33) OVER w END')} AS close_low, {R('CASE WHEN count(close) OVER w >= 10 THEN quantile_cont(close, 0.67) OVER w END')} AS close_high FROM m WINDOW w AS (ORDER BY date)""")
def _(t):
    from panelstone.operators.calendar import month_end_sessions
    m = t.market.select("date", F.col("close_adj").alias("close")).join(F.broadcast(month_end_sessions(t.sessions)), "date", "left_semi")
    return rounded(E.expanding_bands(m, "close").select("date", "close_low", "close_high"))


@query("wn31_row_index", "{{with px}} SELECT ticker, date, CAST(row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS INTEGER) AS i FROM px")
def _(t):
    return t.prices.select("ticker", "date", (F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1).alias("i"))


@query("wn33_forward_fill", f"{{{{with px}}}} SELECT ticker, date, {R('last_value(CASE WHEN dividend > 0 THEN dividend END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date)')} AS last_dividend FROM px")
def _(t):
    df = t.prices.withColumn("paid", F.when(F.col("dividend") > 0, F.col("dividend")))
    return rounded(df.select("ticker", "date", forward_fill("paid", ["ticker"], "date").alias("last_dividend")))


@query("wn15_margin_stability", "{{with tb}} SELECT ticker, date, " + R("1 / (1 + 10 * CASE WHEN count(ret_1d) OVER w >= 8 THEN stddev_samp(ret_1d) OVER w END)") + " AS stability FROM tb WINDOW w AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 364 DAY PRECEDING AND CURRENT ROW)")
def _(t):
    from panelstone.operators.rolling import day_rolling
    df = t.prices.withColumn("ret_1d", F.try_divide("close_adj", F.lag("close_adj", 1).over(Window.partitionBy("ticker").orderBy("date"))) - 1.0)
    dev = day_rolling("ret_1d", "std", ["ticker"], "date", 365, 8)
    return rounded(df.select("ticker", "date", (1.0 / (1.0 + 10.0 * dev)).alias("stability")))


fragment("rg", f"""SELECT date, close, close / max(close) OVER (ORDER BY date) - 1 AS from_peak, CASE WHEN count(*) OVER (ORDER BY date ROWS 199 PRECEDING) = 200 THEN avg(close) OVER (ORDER BY date ROWS 199 PRECEDING) END AS ma200, CASE WHEN count(r) OVER (ORDER BY date ROWS 62 PRECEDING) = 63 THEN stddev_samp(r) OVER (ORDER BY date ROWS 62 PRECEDING) END AS vol63
   FROM (SELECT date, close, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM mk)""", "mk")


@query("ev10_regimes", f"""{{{{with rg, mend}}}}, a AS (SELECT *, ma200 / lag(ma200, 63) OVER (ORDER BY date) - 1 AS slope FROM rg), d AS (SELECT * FROM a WHERE date IN (SELECT date FROM mend)),
   b AS (SELECT *, CASE WHEN count(vol63) OVER (ORDER BY date) >= 10 THEN quantile_cont(vol63, 0.33) OVER (ORDER BY date) END AS lo, CASE WHEN count(vol63) OVER (ORDER BY date) >= 10 THEN quantile_cont(vol63, 0.67) OVER (ORDER BY date) END AS hi FROM d)
   SELECT date, CASE WHEN from_peak <= -0.1 THEN 'bear' WHEN close > ma200 AND slope > 0 THEN 'bull' ELSE 'neutral' END AS trend_regime, CASE WHEN vol63 >= hi THEN 'high_volatility' WHEN vol63 <= lo THEN 'low_volatility' ELSE 'mid_volatility' END AS volatility_regime, {R('from_peak')} AS from_peak FROM b""")
def _(t):
    from panelstone.operators.calendar import month_end_sessions
    yields = t.market.select(F.date_add("date", 2).alias("date"), (F.col("close_adj") / 10).alias("value"))
    out = E.classify_regimes(t.market.select("date", "close_adj"), month_end_sessions(t.sessions), yields)
    return rounded(out.select("date", "trend_regime", "volatility_regime", "from_peak"))
