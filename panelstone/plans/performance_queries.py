"""Portfolios, equity paths, statistical corrections, registry, gates and quality checks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelstone.operators import holdings as HD
from panelstone.operators import performance as PM
from panelstone.operators import portfolio as PF
from panelstone.operators import reports as Q
from panelstone.operators import variants as VR
from panelstone.operators import verdicts as VD
from panelstone.plans.base import MARKET, R, Tables, fragment, query, round_sql, rounded
from panelstone.session import cut_lineage, shared_folder, stacked
from panelstone.sources import registry as RG
from panelstone.sources import tables as S

# Equity paths: one run per region, its daily return a damped change of the region's price; the market is the benchmark.
fragment("eq", """SELECT 'run_' || sector AS run_id, date, 100 * exp(sum(r) OVER (PARTITION BY sector ORDER BY date)) AS equity, 100 * exp(sum(m) OVER (PARTITION BY sector ORDER BY date)) AS benchmark FROM (
   SELECT sector, sf.date, ln(1 + 0.05 * coalesce(sf.close / lag(sf.close) OVER (PARTITION BY sector ORDER BY sf.date) - 1, 0)) AS r, ln(1 + 0.05 * coalesce(mk.close / lag(mk.close) OVER (PARTITION BY sector ORDER BY sf.date) - 1, 0)) AS m FROM sf JOIN mk ON mk.date = sf.date)""", "sf", "mk")
fragment("er", "SELECT *, equity / lag(equity) OVER w - 1 AS ret, benchmark / lag(benchmark) OVER w - 1 AS bret, equity / max(equity) OVER w - 1 AS dd, row_number() OVER w AS rn FROM eq WINDOW w AS (PARTITION BY run_id ORDER BY date)", "eq")


def paths(t: Tables):
    funds = t.sector_funds.select("ticker", "date", "close_adj").join(t.market.select("date", F.col("close_adj").alias("m")), "date")
    w = Window.partitionBy("ticker").orderBy("date")
    step = lambda x: F.log(1 + 0.05 * F.coalesce(F.try_divide(x, F.lag(x, 1).over(w)) - 1, F.lit(0.0)))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = funds.withColumns({"_r": step("close_adj"), "_m": step("m")})
    run = F.concat(F.lit("run_"), F.expr("substring(ticker, 3)"))
    return cut_lineage(out.select(run.alias("run_id"), "date", (100 * F.exp(F.sum("_r").over(upto))).alias("equity"), (100 * F.exp(F.sum("_m").over(upto))).alias("benchmark")))


_BS = ["total_return", "cagr", "volatility", "sharpe", "sortino", "max_drawdown", "calmar"]
fragment("bs", """SELECT run_id, count(*) AS n_sessions, arg_max(equity, date) / arg_min(equity, date) - 1 AS total_return, pow(arg_max(equity, date) / arg_min(equity, date), 365.25 / (max(date) - min(date))) - 1 AS cagr, stddev_samp(ret) * sqrt(252) AS volatility,
   avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, avg(ret) / sqrt(sum(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END) / count(ret)) * sqrt(252) AS sortino, min(dd) AS max_drawdown, (pow(arg_max(equity, date) / arg_min(equity, date), 365.25 / (max(date) - min(date))) - 1) / abs(min(dd)) AS calmar FROM er GROUP BY 1""", "er")


@query("ev22_basic_statistics", "{{with bs}} " + round_sql("SELECT * FROM bs", ["run_id", "n_sessions", *_BS], _BS))
def _(t):
    return rounded(PM.basic_statistics(paths(t)).select("run_id", "n_sessions", *_BS))


fragment("ep", """SELECT run_id, k, min(date) AS start, max(date) AS lst, count(*) AS n, arg_min(date, (equity, date)) AS trough FROM (SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY date) AS k FROM er) GROUP BY 1, 2""", "er")
fragment("ee", "SELECT run_id, start, trough, recovered, CAST(coalesce(recovered, lst) - start AS INTEGER) AS days FROM (SELECT *, lead(start) OVER (PARTITION BY run_id ORDER BY k) AS recovered FROM ep) WHERE n > 1", "ep")


@query("ev23_drawdown_duration", "{{with ee}} SELECT run_id, days, start, trough, recovered FROM ee QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY days DESC, start) = 1")
def _(t):
    return PM.drawdown_duration(paths(t))


_BM = ["beta", "alpha_annual", "tracking_error", "information_ratio", "upside_capture", "downside_capture"]
fragment("bm", """SELECT run_id, count(*) AS n, covar_samp(ret, bret) / var_samp(bret) AS beta, pow(1 + avg(ret) - covar_samp(ret, bret) / var_samp(bret) * avg(bret), 252) - 1 AS alpha_annual, stddev_samp(ret - bret) * sqrt(252) AS tracking_error, avg(ret - bret) / stddev_samp(ret - bret) * sqrt(252) AS information_ratio,
   avg(ret) FILTER (bret > 0) / avg(bret) FILTER (bret > 0) AS upside_capture, avg(ret) FILTER (bret < 0) / avg(bret) FILTER (bret < 0) AS downside_capture FROM er WHERE ret IS NOT NULL GROUP BY 1""", "er")


@query("ev24_benchmark_statistics", "{{with bm}} " + round_sql("SELECT * FROM bm", ["run_id", "n", *_BM], _BM))
def _(t):
    return rounded(PM.benchmark_statistics(paths(t)).select("run_id", "n", *_BM))


fragment("pm", """SELECT run_id, period, e / coalesce(lag(e) OVER (PARTITION BY run_id ORDER BY period), b) - 1 AS ret FROM (SELECT run_id, CAST(date_trunc('month', date) AS DATE) AS period, arg_max(equity, date) AS e, arg_min(equity, date) AS b FROM eq GROUP BY 1, 2)""", "eq")


@query("ev25_periodic_returns", f"{{{{with pm}}}} SELECT run_id, period, {R('ret')} AS \"return\" FROM pm")
def _(t):
    return rounded(PM.periodic_returns(paths(t)))


fragment("ro12", "SELECT run_id, equity / lag(equity, 252) OVER w - benchmark / lag(benchmark, 252) OVER w AS g FROM eq WINDOW w AS (PARTITION BY run_id ORDER BY date)", "eq")


@query("ev26_rolling_outperformance", f"{{{{with ro12}}}} SELECT run_id, count(g) AS windows, count(*) FILTER (g > 0) AS beat, {R('avg(CASE WHEN g > 0 THEN 1.0 WHEN g <= 0 THEN 0.0 END)')} AS share, {R('median(g)')} AS median_excess, {R('min(g)')} AS worst_excess, {R('max(g)')} AS best_excess FROM ro12 WHERE g IS NOT NULL GROUP BY 1")
def _(t):
    return rounded(PM.rolling_outperformance(paths(t), 12))


@query("ag17_beat_share", f"{{{{with pm}}}} SELECT run_id, {R('avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)')} AS positive_months, count(*) AS months FROM pm GROUP BY 1")
def _(t):
    m = PM.periodic_returns(paths(t))
    return rounded(m.groupBy("run_id").agg(F.avg((F.col("return") > 0).cast("double")).alias("positive_months"), F.count(F.lit(1)).alias("months")))


@query("ev27_bootstrap_intervals")
def _(t):
    return rounded(PM.bootstrap_intervals(paths(t), samples=200))


fragment("mo", "SELECT run_id, n, m / s AS sr, avg(pow((ret - m) / s, 3)) AS skew, avg(pow((ret - m) / s, 4)) AS kurtosis FROM er JOIN (SELECT run_id, count(ret) AS n, avg(ret) AS m, stddev_samp(ret) AS s FROM er GROUP BY 1) USING (run_id) WHERE ret IS NOT NULL GROUP BY 1, 2, 3", "er")


@query("ev28_return_moments", f"{{{{with mo}}}} SELECT run_id, n, {R('sr')} AS sr, {R('skew', 5)} AS skew, {R('kurtosis', 5)} AS kurtosis FROM mo")
def _(t):
    return rounded(PM.return_moments(paths(t)), 5, sr=6)


@query("ev28_deflated_sharpe")
def _(t):
    return rounded(PM.deflated_sharpe(PM.return_moments(paths(t)), 20), 6)


fragment("pb", """SELECT s, run_id, sum(CASE WHEN i THEN 1.0 ELSE 0 END) AS k1, avg(ret) FILTER (i) / stddev_samp(ret) FILTER (i) AS a, avg(ret) FILTER (NOT i) / stddev_samp(ret) FILTER (NOT i) AS b FROM (
     SELECT c.s, run_id, ret, (c.s >> blk) & 1 = 1 AS i FROM (SELECT run_id, ret, CASE WHEN ix < n % 4 * (n // 4 + 1) THEN ix // (n // 4 + 1) ELSE n % 4 + (ix - n % 4 * (n // 4 + 1)) // (n // 4) END AS blk FROM (SELECT *, dense_rank() OVER (ORDER BY period) - 1 AS ix, (SELECT count(DISTINCT period) FROM pm) AS n FROM pm)) JOIN (SELECT unnest(range(16)) AS s) c ON bit_count(CAST(c.s AS INTEGER)) = 2) GROUP BY 1, 2""", "pm")
fragment("pb2", """SELECT s, count(*) AS n_trials, arg_max(run_id, (a, run_id)) AS best, arg_max(b, (a, run_id)) AS bb FROM pb GROUP BY 1""", "pb")


@query("ev29_overfitting_probability", f"""{{{{with pb2}}}}, r AS (SELECT p.s, n_trials, count(*) FILTER (b < bb OR (b = bb AND run_id <= best)) AS k FROM pb p JOIN pb2 USING (s) GROUP BY 1, 2), l AS (SELECT ln((k / (n_trials + 1)) / (1 - k / (n_trials + 1))) AS lg, n_trials FROM r)
   SELECT {R('avg(CASE WHEN lg <= 0 THEN 1.0 ELSE 0 END)')} AS pbo, {R('median(lg)')} AS median_logit, count(*) AS n_partitions FROM l""")
def _(t):
    out = PM.overfitting_probability(PM.periodic_returns(paths(t)), splits=4)
    return rounded(out.select("pbo", "median_logit", "n_partitions"))


@query("ev30_risk_matched", f"""{{{{with er}}}}, v AS (SELECT run_id, stddev_samp(ret) / stddev_samp(bret) AS ratio FROM er GROUP BY 1) SELECT run_id, date, {R('exp(sum(ln(1 + coalesce(ratio * bret, 0))) OVER (PARTITION BY run_id ORDER BY date))')} AS level FROM er JOIN v USING (run_id)""")
def _(t):
    return rounded(PM.risk_matched(paths(t)).select("run_id", "date", "level"))


@query("ev30_benchmark_path", f"""{{{{with mk, pan}}}}, d AS (SELECT DISTINCT date + 1 AS date FROM pan), f AS (SELECT date, last_value(close IGNORE NULLS) OVER (ORDER BY date) AS l, first_value(close IGNORE NULLS) OVER (ORDER BY date) AS b FROM d LEFT JOIN mk USING (date)) SELECT date, {R('l / b')} AS level FROM f""")
def _(t):
    dates = t.panel.select(F.date_add("date", 1).alias("date")).distinct()
    return rounded(PM.benchmark_path(t.market, dates, MARKET))


_MONTHS = {"positive_months": "avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret <= 0 THEN 0.0 END)", "best_month": "max(ret)", "worst_month": "min(ret)"}


@query("ev31_summarise", "{{with bs, bm, pm}} " + " UNION ALL ".join([f"SELECT run_id, '{m}' AS metric, {R(m)} AS value FROM {src}" for src, cols in (("bs", _BS), ("bm", _BM)) for m in cols] + [f"SELECT run_id, '{m}', {R(x)} FROM pm GROUP BY 1" for m, x in _MONTHS.items()]))
def _(t):
    return rounded(PM.summarise(paths(t)))


@query("ev34_trial_returns", f"{{{{with pm}}}} SELECT run_id, period, {R('ret')} AS \"return\" FROM pm WHERE run_id IN (SELECT run_id FROM pm GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT period) FROM pm))")
def _(t):
    return rounded(PM.trial_return_matrix(paths(t)))


@query("rq11_thin_curve", f"{{{{with er}}}} SELECT run_id, date, {R('equity / first_value(equity) OVER (PARTITION BY run_id ORDER BY date)')} AS level FROM er QUALIFY (rn - 1) % 25 = 0 OR date = max(date) OVER (PARTITION BY run_id)")
def _(t):
    return rounded(Q.thin_curve(paths(t), 25))


# ---- portfolios over the month panel

fragment("wt", "SELECT company_id, ticker, sector, date, 0.05::DOUBLE AS weight FROM pan QUALIFY row_number() OVER (PARTITION BY date ORDER BY roic DESC, company_id) <= 20", "pan")
TOLERANCE = 5  # sessions a price may lie behind an execution: a supplier trades on about every fifth
fragment("ses", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM sd)", "sd")
fragment("dec", "SELECT date, idx FROM ses WHERE date IN (SELECT date FROM pan)", "ses", "pan")
fragment("pln", "SELECT 'offset ' || o || ' delay ' || dl AS plan, o, dl FROM (VALUES (0, 1), (0, 2), (0, 3), (0, 5), (-5, 1), (-1, 1), (1, 1), (5, 1)) v(o, dl)")
fragment("sch", """SELECT *, row_number() OVER w AS period, lead(idx) OVER w AS nidx, lead(exec_date) OVER w AS next_date FROM (
   SELECT plan, e.idx, e.date AS exec_date, (SELECT max(k.date) FROM dec k WHERE k.idx <= d.idx + o) AS date FROM dec d JOIN pln ON true JOIN ses e ON e.idx = d.idx + o + dl WHERE d.idx + o >= 0) WHERE date IS NOT NULL WINDOW w AS (PARTITION BY plan ORDER BY idx)""", "ses", "dec", "pln")
fragment("pw", f"""SELECT plan, ticker, period, min(px.date) FILTER (x.idx - s.idx <= {TOLERANCE}) AS fd, arg_min(close_adj, px.date) FILTER (x.idx - s.idx <= {TOLERANCE}) AS fp, max(px.date) AS ld, arg_max(close_adj, px.date) AS lp
   FROM sch s JOIN ses x ON x.idx BETWEEN s.idx AND coalesce(nidx - 1, s.idx + {TOLERANCE}) JOIN px ON px.date = x.date GROUP BY ALL""", "px", "sch", "ses")
FATES = """SELECT *, CASE state WHEN 'not_bought' THEN 0 WHEN 'held' THEN xp / fp - 1 WHEN 'liquidated' THEN lp / fp - 1 WHEN 'written_off' THEN -1.0 END AS ret, CASE WHEN state <> 'not_bought' THEN weight ELSE 0 END AS w FROM (
   SELECT t.*, exec_date, next_date, a.fd, a.fp, a.ld, a.lp, b.fd AS xd, b.fp AS xp, CASE WHEN a.fp IS NULL THEN 'not_bought' WHEN next_date IS NULL THEN 'open' WHEN b.fp IS NOT NULL THEN 'held' WHEN a.ld > a.fd THEN 'liquidated' ELSE 'written_off' END AS state
   FROM {0} t JOIN sch USING (plan, period) LEFT JOIN pw a ON (a.plan, a.ticker, a.period) = (t.plan, t.ticker, t.period) LEFT JOIN pw b ON (b.plan, b.ticker, b.period) = (t.plan, t.ticker, t.period + 1))"""
PERIODS = """SELECT run, period, any_value(exec_date) AS exec_date, any_value(next_date) AS next_date, CASE WHEN any_value(next_date) IS NOT NULL THEN coalesce(sum(w * ret) FILTER (state <> 'not_bought'), 0) END AS gross,
   count(*) FILTER (state = 'held') AS n_held, count(*) FILTER (state = 'liquidated') AS n_liquidated, count(*) FILTER (state = 'written_off') AS n_written_off, count(*) FILTER (state = 'not_bought') AS n_not_bought, count(*) FILTER (state = 'open') AS n_open FROM {0} GROUP BY 1, 2"""
TURNOVER = """SELECT run, period, sum(abs(x)) AS turnover FROM (SELECT run, period, ticker, sum(x) AS x FROM (SELECT run, period, ticker, w AS x FROM {0} UNION ALL
   SELECT h.run, h.period + 1, ticker, -coalesce(w * (1 + ret) / nullif(1 + gross, 0), 0) FROM {0} h JOIN {1} g ON (g.run, g.period) = (h.run, h.period) WHERE state IN ('held', 'liquidated', 'written_off')) GROUP BY ALL) GROUP BY ALL"""
fragment("wt1", "SELECT 'only' AS run, plan, period, wt.* FROM wt JOIN sch USING (date) WHERE plan = 'offset 0 delay 1'", "wt", "sch")
fragment("hp", FATES.format("wt1"), "wt1", "sch", "pw")
fragment("gr", PERIODS.format("hp"), "hp")
fragment("tv", TURNOVER.format("hp", "gr"), "hp", "gr")


def weights(t: Tables):
    return PF.add_weights(PF.select_names(t.panel, 20, score="roic", entity="company_id"), score="roic").select("company_id", "ticker", "sector", "date", "weight")


_FATE = ["n_held", "n_liquidated", "n_written_off", "n_not_bought", "n_open"]


@query("ev19_period_returns", f"{{{{with gr, tv, sch}}}} SELECT s.date, g.exec_date, g.next_date, {R('gross')} AS gross, {R('turnover')} AS turnover, {R('gross - turnover * 0.00045')} AS net, {', '.join(_FATE)} FROM gr g JOIN tv USING (run, period) JOIN sch s ON s.plan = 'offset 0 delay 1' AND s.period = g.period")
def _(t):
    out = PF.period_returns(cut_lineage(weights(t)), t.prices.select("ticker", "date", "close_adj"), t.sessions, tolerance=TOLERANCE)
    return rounded(out.select("date", "exec_date", "next_date", "gross", "turnover", "net", *_FATE))


@query("ev19_exits", f"{{{{with hp}}}} SELECT ticker, exec_date, state, fd AS entry_date, CASE state WHEN 'held' THEN xd WHEN 'liquidated' THEN ld END AS exit_date, {R('ret')} AS ret FROM hp WHERE state <> 'held'")
def _(t):
    held = PF.holding_returns(cut_lineage(weights(t)), t.prices.select("ticker", "date", "close_adj"), t.sessions, tolerance=TOLERANCE)
    return rounded(held.where("state <> 'held'").select("ticker", "exec_date", "state", "entry_date", "exit_date", "ret"))


@query("ev21_tranches", f"""{{{{with wt}}}}, i AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM wt)), s AS (SELECT ticker, i.k + x AS k, weight FROM wt JOIN i USING (date), (SELECT unnest(range(3)) AS x)) SELECT ticker, i.date, {R('sum(weight) / 3')} AS weight FROM s JOIN i ON i.k = s.k GROUP BY 1, 2""")
def _(t):
    return rounded(PF.tranche_weights(cut_lineage(weights(t)), 3))


@query("ev32_trades", f"""{{{{with wt}}}}, w AS (SELECT 'r' AS run_id, * FROM wt), o AS (SELECT ticker, lead_date AS date, weight FROM (SELECT wt.*, nd AS lead_date FROM wt JOIN (SELECT date, lead(date) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM wt)) USING (date)) WHERE lead_date IS NOT NULL)
   SELECT coalesce(n.ticker, o.ticker) AS ticker, coalesce(n.date, o.date) AS date, CASE WHEN o.ticker IS NULL THEN 'buy' ELSE 'sell' END AS side, {R('coalesce(n.weight, 0) - coalesce(o.weight, 0)')} AS delta_weight FROM wt n FULL JOIN o ON o.ticker = n.ticker AND o.date = n.date WHERE n.ticker IS NULL OR o.ticker IS NULL""")
def _(t):
    w = cut_lineage(weights(t)).withColumn("run_id", F.lit("r"))
    return rounded(VD.trades(w, entity="ticker").select("ticker", "date", "side", "delta_weight"))


fragment("hc", "SELECT * FROM hp WHERE state IN ('held', 'liquidated', 'written_off')", "hp")


def closed_holdings(t: Tables):
    w = cut_lineage(weights(t))
    held = PF.holding_returns(w, t.prices.select("ticker", "date", "close_adj"), t.sessions, tolerance=TOLERANCE)
    return w, held.where(F.col("state").isin(*HD.BOUGHT)).select("ticker", "date", "ret")


@query("ev37_contributors", f"""{{{{with hc}}}}, c AS (SELECT ticker, round(sum(weight * ret), 9) AS x FROM hc GROUP BY 1) SELECT * FROM (SELECT ticker, {R('x')} AS contribution, 'top' AS side FROM c ORDER BY x DESC, ticker LIMIT 10) UNION ALL SELECT * FROM (SELECT ticker, {R('x')}, 'bottom' FROM c ORDER BY x, ticker LIMIT 10)""")
def _(t):
    return rounded(PF.contributors(*closed_holdings(t), "ticker", 10))


@query("ev37_contributors_by_sector", f"""{{{{with hc}}}}, c AS (SELECT sector, round(sum(weight * ret), 9) AS x FROM hc GROUP BY 1) SELECT * FROM (SELECT sector, {R('x')} AS contribution, 'top' AS side FROM c ORDER BY x DESC, sector LIMIT 3) UNION ALL SELECT * FROM (SELECT sector, {R('x')}, 'bottom' FROM c ORDER BY x, sector LIMIT 3)""")
def _(t):
    return rounded(PF.contributors(*closed_holdings(t), "sector", 3))


# ---- registry, gates, robustness

fragment("meas", """SELECT 'c' || c_custkey AS run_id, m.metric, m.value FROM (SELECT *, unnest([{'metric': 'exits_observed', 'value': c_custkey % 4.0}, {'metric': 'removed_priced_share', 'value': 0.9 + c_custkey % 3 * 0.05}, {'metric': 'delisting_known_share', 'value': 1.0}, {'metric': 'point_in_time', 'value': CASE WHEN c_custkey % 13 = 0 THEN 0.0 ELSE 1.0 END},
   {'metric': 'estimates_excluded', 'value': 1.0}, {'metric': 'execution_delay_days', 'value': 1.0}, {'metric': 'benchmark_coverage', 'value': 1.0}, {'metric': 'ic_mean_3m', 'value': c_acctbal / 100000}, {'metric': 'ic_t_3m', 'value': c_acctbal / 2000}, {'metric': 'decile_spread_3m', 'value': c_acctbal},
   {'metric': 'decile_monotonicity', 'value': CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 0.6 END}, {'metric': 'excess_cagr_net_spy', 'value': c_acctbal / 1000}, {'metric': 'information_ratio_net_spy', 'value': c_acctbal / 10000}]) AS m FROM customer)""")


def measurements(t: Tables):
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    cells = {"exits_observed": (k % 4).cast("double"), "removed_priced_share": F.lit(0.9) + k % 3 * 0.05, "delisting_known_share": F.lit(1.0), "point_in_time": F.when(k % 13 == 0, 0.0).otherwise(1.0), "estimates_excluded": F.lit(1.0), "execution_delay_days": F.lit(1.0),
             "benchmark_coverage": F.lit(1.0), "ic_mean_3m": b / 100000, "ic_t_3m": b / 2000, "decile_spread_3m": b, "decile_monotonicity": F.when(k % 7 != 0, 0.6), "excess_cagr_net_spy": b / 1000, "information_ratio_net_spy": b / 10000}
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), e.cast("double").alias("value")) for n, e in cells.items()])
    return t.raw("customer").select(F.concat(F.lit("c"), k.cast("string")).alias("run_id"), F.explode(rows).alias("_m")).select("run_id", "_m.*")


_DG = ", ".join(f"('{a}', '{b}', {c}, '{d}')" for a, b, c, d in VD.DATA_GATES)
_RG = ", ".join(f"('{a}', '{b}', {c})" for a, b, c in VD.RESULT_GATES)
fragment("dg", f"SELECT run_id, gate, caps, coalesce(value >= minimum - 1e-12, false) AS passed FROM meas JOIN (VALUES {_DG}) g(gate, metric, minimum, caps) USING (metric)", "meas")
fragment("rgt", f"SELECT run_id, gate, coalesce(value >= minimum, false) AS passed FROM meas JOIN (VALUES {_RG}) g(gate, metric, minimum) USING (metric)", "meas")


@query("ev35_gates", "{{with dg, rgt}} SELECT run_id, gate, passed FROM dg UNION ALL SELECT run_id, gate, passed FROM rgt")
def _(t):
    m = measurements(t).withColumn("value", F.round("value", 9))
    return VD.evaluate_gates(m, VD.DATA_GATES).transform(stacked, VD.evaluate_gates(m, VD.RESULT_GATES)).select("run_id", "gate", "passed")


@query("ev35_decide", """{{with dg, rgt}}, s AS (SELECT run_id, CASE WHEN bool_or(NOT passed AND caps = 'not_testable') THEN 'not_testable' WHEN bool_or(NOT passed AND caps = 'exploratory_only') THEN 'exploratory_only' ELSE 'in_sample' END AS st, count(*) FILTER (NOT passed) AS fd FROM dg GROUP BY 1),
   r AS (SELECT run_id, count(*) FILTER (passed) AS cl, count(*) AS n FROM rgt GROUP BY 1), p AS (SELECT 'c' || c_custkey AS run_id, CASE c_custkey % 3 WHEN 0 THEN 'development' WHEN 1 THEN 'validation' ELSE 'holdout' END AS period, CASE WHEN c_custkey % 5 = 0 THEN 20 ELSE 60 END AS nd FROM customer)
   SELECT run_id, CASE WHEN st <> 'in_sample' THEN st WHEN period = 'development' THEN 'in_sample' ELSE period || CASE WHEN cl = n THEN '_passed' ELSE '_failed' END END AS status,
   CASE WHEN st = 'not_testable' THEN 'backtest_invalid' WHEN nd < 36 THEN 'insufficient_data' WHEN fd > 0 THEN 'backtest_invalid' WHEN cl = n THEN 'evidence_of_predictive_ability' WHEN cl = 0 THEN 'no_meaningful_evidence' ELSE 'evidence_is_mixed' END AS conclusion FROM s JOIN r USING (run_id) JOIN p USING (run_id)""")
def _(t):
    m = cut_lineage(measurements(t).withColumn("value", F.round("value", 9)))
    k = F.col("c_custkey")
    periods = t.raw("customer").select(F.concat(F.lit("c"), k.cast("string")).alias("run_id"), F.when(k % 3 == 0, "development").when(k % 3 == 1, "validation").otherwise("holdout").alias("period"), F.when(k % 5 == 0, 20).otherwise(60).alias("n_decision_dates"))
    return VD.decide(VD.evaluate_gates(m, VD.DATA_GATES), VD.evaluate_gates(m, VD.RESULT_GATES), periods).select("run_id", "status", "conclusion")


STRATEGIES = ("roic", "ret_3m", "earnings_yield", "price_to_book", "market_cap")
fragment("var", "SELECT *, 'offset ' || o || ' delay ' || dl AS plan FROM (VALUES ('base', 'base', 20, 20, false, 1, 0, 1, 0), ('double_costs', '2x', 20, 20, false, 1, 0, 2, 0), ('double_costs', '4x', 20, 20, false, 1, 0, 4, 0),"
    " ('execution_delay', '2 days', 20, 20, false, 2, 0, 1, 0), ('execution_delay', '3 days', 20, 20, false, 3, 0, 1, 0), ('execution_delay', '5 days', 20, 20, false, 5, 0, 1, 0), ('rebalance_shift', '-5 days', 20, 20, false, 1, -5, 1, 0),"
    " ('rebalance_shift', '-1 day', 20, 20, false, 1, -1, 1, 0), ('rebalance_shift', '+1 day', 20, 20, false, 1, 1, 1, 0), ('rebalance_shift', '+5 days', 20, 20, false, 1, 5, 1, 0), ('drop_winners', 'drop top 1', 20, 20, false, 1, 0, 1, 1),"
    " ('drop_winners', 'drop top 3', 20, 20, false, 1, 0, 1, 3), ('drop_winners', 'drop top 5', 20, 20, false, 1, 0, 1, 5), ('sector_cap', '30%', 20, 6, false, 1, 0, 1, 0), ('sector_cap', '20%', 20, 4, false, 1, 0, 1, 0),"
    " ('weighting', 'score-proportional', 20, 20, true, 1, 0, 1, 0), ('threshold', '15 names', 15, 15, false, 1, 0, 1, 0), ('threshold', '25 names', 25, 25, false, 1, 0, 1, 0), ('threshold', '30 names', 30, 30, false, 1, 0, 1, 0)) v(test, variant, n, ps, prop, dl, o, cf, dk)")
fragment("rkd", " UNION ALL ".join(f"SELECT '{x}' AS strategy, ticker, sector, date, {x} AS score FROM pan WHERE {x} IS NOT NULL" for x in STRATEGIES), "pan")
WEIGHTS = """SELECT strategy, test, variant, strategy || '|' || test || '|' || variant AS run, plan, period, ticker, cf, CASE WHEN prop AND sum(score) OVER r - count(*) OVER r * min(score) OVER r > 1e-12 THEN (score - min(score) OVER r) / (sum(score) OVER r - count(*) OVER r * min(score) OVER r) ELSE 1.0 / count(*) OVER r END AS weight FROM (
   SELECT * FROM (SELECT k.*, v.*, period FROM rkd k JOIN sch USING (date) JOIN var v ON v.plan = sch.plan WHERE {0} QUALIFY row_number() OVER (PARTITION BY strategy, test, variant, period, sector ORDER BY score DESC, ticker) <= ps)
   QUALIFY row_number() OVER (PARTITION BY strategy, test, variant, period ORDER BY score DESC, ticker) <= n) WINDOW r AS (PARTITION BY strategy, test, variant, period)"""
fragment("wb", WEIGHTS.format("test = 'base'"), "rkd", "sch", "var")
fragment("hb", FATES.format("wb"), "wb", "sch", "pw")
fragment("win", "SELECT strategy, ticker, row_number() OVER (PARTITION BY strategy ORDER BY round(sum(weight * ret), 9) DESC, ticker) AS place FROM hb WHERE state IN ('held', 'liquidated', 'written_off') GROUP BY 1, 2", "hb")
fragment("wv", WEIGHTS.format("NOT EXISTS (SELECT 1 FROM win x WHERE x.strategy = k.strategy AND x.ticker = k.ticker AND x.place <= v.dk)"), "rkd", "sch", "var", "win")
fragment("hv", FATES.format("wv"), "wv", "sch", "pw")
fragment("gv", PERIODS.format("hv"), "hv")
fragment("tvv", TURNOVER.format("hv", "gv"), "hv", "gv")
fragment("rgw", """SELECT strategy, test, variant, pow(g, 365.25 / d) - 1 AS cagr, pow(g, 365.25 / d) - pow(z.close / a.close, 365.25 / d) AS excess FROM (
   SELECT split_part(run, '|', 1) AS strategy, split_part(run, '|', 2) AS test, v.variant, product(greatest(1 + gross - turnover * 0.00045 * cf, 0)) AS g, min(exec_date) AS s, max(next_date) AS e, max(next_date) - min(exec_date) AS d
   FROM gv JOIN tvv USING (run, period) JOIN var v ON v.test = split_part(run, '|', 2) AND v.variant = split_part(run, '|', 3) WHERE next_date IS NOT NULL GROUP BY ALL) JOIN mk a ON a.date = s JOIN mk z ON z.date = e""", "gv", "tvv", "var", "mk")
fragment("rv", """SELECT g.*, b.excess AS base, CASE WHEN b.excess IS NULL OR g.excess IS NULL THEN 'not_measurable' WHEN b.excess <= 0 THEN 'not_applicable' WHEN g.excess <= 0 THEN 'failed' WHEN g.excess / b.excess < CASE WHEN g.test = 'rebalance_shift' THEN 0.7 ELSE 0.5 END THEN 'weakened' ELSE 'survived' END AS verdict
   FROM rgw g LEFT JOIN rgw b ON b.strategy = g.strategy AND b.test = 'base' WHERE g.test <> 'base'""", "rgw")


def robustness(t: Tables):
    """Five strategies, each ranked by one column of the panel, through all declared variants."""
    t.keep_days()
    cells = F.array(*[F.struct(F.lit(x).alias("strategy"), F.col(x).alias("score")) for x in STRATEGIES])
    ranked = t.panel.select("ticker", "sector", "date", F.explode(cells).alias("_c")).select("ticker", "sector", "date", "_c.*")
    return VR.robustness(ranked, t.prices.select("ticker", "date", "close_adj"), t.sessions, cut_lineage(t.market), tolerance=TOLERANCE)


@query("ev36_robustness", f"{{{{with rv}}}} SELECT strategy, test, variant, {R('cagr')} AS cagr, {R('excess')} AS excess, {R('base')} AS base_excess, verdict FROM rv")
def _(t):
    return rounded(robustness(t).select("strategy", "test", "variant", "cagr", "excess", "base_excess", "verdict"))


_SHARE = "count(*) FILTER (verdict = 'survived') / nullif(count(*) FILTER (verdict NOT LIKE 'not%'), 0)"


@query("ev36_robustness_summary", f"{{{{with rv}}}} SELECT strategy, count(*) AS n_tests, count(*) FILTER (verdict = 'survived') AS survived, count(*) FILTER (verdict = 'failed') AS failed, {R(_SHARE)} AS survived_share FROM rv GROUP BY 1")
def _(t):
    return rounded(VD.robustness_summary(robustness(t), "strategy").select("strategy", "n_tests", "survived", "failed", "survived_share"))


fragment("reg_daily", "SELECT exec_date AS date, product(CASE WHEN next_date IS NULL THEN 1 ELSE 1 + gross - turnover * 0.00045 END) OVER (ORDER BY exec_date) AS equity FROM gr JOIN tv USING (run, period)", "gr", "tv")
fragment("reg_pos", "SELECT exec_date AS date, period, ticker, weight FROM hp WHERE state <> 'not_bought'", "hp")
fragment("reg_trades", """SELECT coalesce(n.weight, 0) - coalesce(o.weight, 0) AS delta FROM reg_pos n FULL JOIN (SELECT * REPLACE (period + 1 AS period) FROM reg_pos WHERE period < (SELECT max(period) FROM reg_pos)) o USING (period, ticker)""", "reg_pos")
fragment("reg_perf", """SELECT pow(g, p) - 1 AS cagr, pow(z.close / a.close, p) - 1 AS bench FROM (SELECT product(1 + gross - turnover * 0.00045) AS g, min(exec_date) AS s, max(next_date) AS e, 365.25 / (max(next_date) - min(exec_date)) AS p FROM gr JOIN tv USING (run, period) WHERE next_date IS NOT NULL) JOIN mk a ON a.date = s JOIN mk z ON z.date = e""", "gr", "tv", "mk")


@query("ev32_registry", f"""{{{{with reg_daily, reg_pos, reg_trades, reg_perf, rv}}}} SELECT 'backtest_runs' AS name, 1 AS n, NULL::DOUBLE AS total UNION ALL SELECT 'backtest_daily', count(*), {R('sum(equity)')} FROM reg_daily UNION ALL SELECT 'backtest_positions', count(*), {R('sum(weight)')} FROM reg_pos
   UNION ALL SELECT 'backtest_trades', count(*), {R('sum(abs(delta))')} FROM reg_trades WHERE abs(delta) > 1e-12 UNION ALL SELECT 'performance_metrics', 3, {R('cagr + bench + (cagr - bench)')} FROM reg_perf UNION ALL SELECT 'robustness_tests', count(*), {R('sum(excess)')} FROM rv""")
def _(t):
    """A portfolio run and the robustness battery, saved twice: one row of each."""
    t.keep_days()
    held = cut_lineage(PF.holding_returns(cut_lineage(weights(t)), t.prices.select("ticker", "date", "close_adj"), t.sessions, tolerance=TOLERANCE))
    periods = HD.run_periods(held, t.spark.createDataFrame([("only", PF.ONE_WAY_BPS)], "run string, bps double"))
    run = RG.content_id("run", F.lit("roic"), F.lit("top 20, delay 1")).alias("run_id")
    step = F.when(F.col("next_date").isNotNull(), 1 + F.col("net")).otherwise(1.0)
    upto = Window.orderBy("exec_date").rowsBetween(Window.unboundedPreceding, 0)  # one row per rebalance
    daily = periods.select(run, F.col("exec_date").alias("date"), F.product(step).over(upto).alias("equity"), "turnover", "cost")
    positions = cut_lineage(held.where("state <> 'not_bought'").select(run, F.col("exec_date").alias("date"), F.col("ticker").alias("security_id"), "weight"))
    moves = VD.trades(positions).withColumn("cost", F.abs("delta_weight") * PF.ONE_WAY_BPS / 1e4)
    growth = HD.run_growth(periods, t.market).withColumn("run_id", run).unpivot(["run_id"], ["cagr", "benchmark_cagr", "excess"], "metric", "value")
    tests = robustness(t).select(RG.content_id("run", "strategy").alias("run_id"), "test", "variant", F.col("base_excess").alias("base"), F.col("excess").alias("value"), "verdict")
    header = t.spark.range(1).select(run, F.lit("roic").alias("strategy"), F.lit("top 20, delay 1").alias("params"), F.lit("done").alias("status"))
    records = {"backtest_runs": header, "backtest_daily": daily, "backtest_positions": positions, "backtest_trades": moves, "performance_metrics": growth.withColumn("benchmark", F.lit(MARKET)), "robustness_tests": tests}
    records = {k: cut_lineage(v) for k, v in records.items()}
    root = f"{shared_folder(t.spark)}/tables/{uuid.uuid4().hex}"
    for _ in range(2):
        RG.save_results(records, root)
    value = {"backtest_runs": F.lit(None).cast("double"), "backtest_daily": F.col("equity"), "backtest_positions": F.col("weight"), "backtest_trades": F.abs("delta_weight"), "performance_metrics": F.col("value"), "robustness_tests": F.col("value")}
    parts = [S.scan(t.spark, root, k).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total")).select(F.lit(k).alias("name"), "n", "total") for k, v in value.items()]
    return rounded(reduce(stacked, parts))


@query("ev33_trial_registry", """SELECT o_orderpriority AS strategy, count(*) AS n_trials, count(*) FILTER (o_orderstatus = 'P') AS n_holdout FROM orders GROUP BY 1""")
def _(t):
    """Trials recorded in two loads that overlap, and holdout accesses recorded twice."""
    root = f"{shared_folder(t.spark)}/tables/{uuid.uuid4().hex}"
    o = t.raw("orders").select("o_orderstatus", RG.content_id("trial", "o_orderkey").alias("trial_id"), F.col("o_orderdate").alias("recorded_at"), F.col("o_orderpriority").alias("strategy"), F.col("o_orderstatus").alias("period"), F.col("o_custkey").cast("string").alias("params"))
    RG.record(o.where("o_orderstatus <> 'O'"), root, "experiments")
    RG.record(o, root, "experiments")
    looks = o.where("o_orderstatus = 'P'").select(F.col("trial_id").alias("access_id"), F.col("recorded_at").alias("accessed_at"), "strategy", F.lit("confirmation").alias("reason"))
    for _ in range(2):
        RG.record(looks, root, "holdout_audit")
    return RG.trials_by_strategy(t.spark, root)


@query("ev33_trial_count", "SELECT count(*) AS n_trials FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(t):
    return VD.trial_count(t.raw("orders").withColumnRenamed("o_orderpriority", "strategy"), "1-URGENT")


@query("ev32_flatten_diagnostics", f"{{{{with bs}}}} SELECT run_id, 'ALL' AS cut, -1 AS horizon, 'cagr' AS metric, {R('cagr')} AS value FROM bs UNION ALL SELECT run_id, 'ALL', -1, 'sharpe', {R('sharpe')} FROM bs")
def _(t):
    return rounded(VD.flatten_diagnostics(PM.basic_statistics(paths(t)), "run_id", {"cut": "ALL", "horizon": -1}, ["cagr", "sharpe"]))


# ---- models

FEATURES = ["roic", "mom_12_1", "ret_3m", "ev_ebit", "earnings_yield"]


@query("ev40_model_importance")
def _(t):
    """Random forest over the panel; trained before the split date, judged after it."""
    from panelstone.operators.models import fit_predict, importances
    model, _ = fit_predict(t.forward, FEATURES, "fwd_1m", 0.8, "random_forest")
    return rounded(importances(t.spark, model, FEATURES))


@query("ev40_model_accuracy")
def _(t):
    from panelstone.operators.models import accuracy, fit_predict
    _, scored = fit_predict(t.forward, FEATURES, "fwd_1m", 0.8, "gradient_boosting")
    return rounded(accuracy(scored, "fwd_1m"))


@query("ev39_rolling_validation")
def _(t):
    from panelstone.operators.models import rolling_validation
    return rounded(rolling_validation(t.forward, FEATURES, "fwd_1m", 3, "random_forest"))


# ---- quality checks


@query("qc4_share_counts", f"""{{{{with fin}}}}, l AS (SELECT company_id, last(net_income ORDER BY date) FILTER (net_income IS NOT NULL) AS ni, last(eps_diluted ORDER BY date) AS eps, last(shares_diluted ORDER BY date) FILTER (shares_diluted IS NOT NULL) AS sd, last(shares_outstanding ORDER BY date) AS so FROM fin GROUP BY 1), g AS (SELECT *, least(abs(sd / (ni / eps) - 1), abs(so / (ni / eps) - 1)) AS gap FROM l WHERE ni / eps > 0)
   SELECT company_id, {R('gap', 4)} AS gap FROM g WHERE gap > 0.15""")
def _(t):
    from panelstone.plans.panel_queries import facts_long
    f = facts_long(t, ["net_income", "eps_diluted", "shares_diluted", "shares_outstanding"])
    return rounded(Q.share_count_disagreement(f).select("company_id", "gap"), 4)


@query("qc6_score_coverage", "{{with os0}}, l AS (SELECT * FROM os0 WHERE date = (SELECT max(date) FROM os0)) SELECT count(*) AS names, count(*) - count(score) AS unscored, count(*) FILTER (coverage < 0.7) AS thin, count(*) FILTER (coverage < 0.7) / count(*) > 0.15 AS too_thin FROM l")
def _(t):
    from panelstone.plans.score_queries import composite
    return Q.score_coverage(composite(t))


@query("qc9_check_all", """{{with ob, px}} SELECT 'error' AS severity, 'stale_filings' AS "check", company_id AS subject, CAST(CAST(DATE '2002-06-01' - max(filed) AS INTEGER) AS VARCHAR) AS detail FROM ob GROUP BY company_id HAVING DATE '2002-06-01' - max(filed) > 110
   UNION ALL SELECT 'warning', 'price_disagreement', ticker, NULL FROM (SELECT ticker, arg_max(close_raw, date) AS a, arg_min(close_raw, date) AS b FROM px GROUP BY 1) WHERE abs(a - b) / b > 0.15""")
def _(t):
    from panelstone.plans.history_queries import observations
    stale = Q.stale_filings(observations(t), t.companies, F.lit("2002-06-01").cast("date"), 110)
    other = t.prices.groupBy("ticker").agg(F.min_by("close_raw", "date").alias("other_price"))
    apart = Q.price_disagreement(t.prices, other)
    return Q.check_all([Q.issue(apart, "warning", "price_disagreement", "ticker", F.lit(None)), Q.issue(stale, "error", "stale_filings", "company_id", F.col("age_days"))])


@query("rq13_hidden_unscored", "{{with os0}}, l AS (SELECT * FROM os0 WHERE date = (SELECT max(date) FROM os0)) SELECT count(*) - count(score) AS hidden_unscored, count(*) FILTER (score >= 45) AS shown FROM l")
def _(t):
    from panelstone.plans.score_queries import composite, latest
    return Q.hidden_unscored(latest(t, composite(t)), 45.0)
