"""Composed valuation: from the panel to every method's outcome and the blended range, and the relative and sensitivity steps on their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstone.functions import numeric as N
from panelstone.operators import appraisal as AP
from panelstone.operators import valuation as V
from panelstone.plans.base import R, Tables, fragment, query, rounded
from panelstone.plans.panel_queries import inputs
from panelstone.session import cut_lineage

MIN_HISTORY = 10


def valued_panel(t: Tables, written: bool = True):
    """The metric panel with estimates, insurers and the data-quality columns that an appraisal asks for.

    Not ``written`` for a reader that writes what it needs of it by itself.
    """
    c, k = F.col, F.col("cik")
    insurer = (c("business_model") == "bank") & (k % 4 == 0)
    df = inputs(t).withColumns({
        "business_model": F.when(insurer, "insurer").otherwise(c("business_model")), "revenue_growth": c("revenue_growth_1y"), "forward_eps_growth": c("eps_growth_1y"),
        "depreciation": c("depreciation_amortization"), "forward_pe": N.div("price", "forward_eps"), "forward_earnings": c("forward_eps") * c("shares"),
        "consensus_revenue_this_year": F.when(k % 4 != 3, c("revenue") * (1.02 + k % 5 * 0.03)), "consensus_revenue_next_year": F.when(k % 4 < 2, c("revenue") * (1.05 + k % 5 * 0.06)),
        "consensus_eps_this_year": c("forward_eps") * 0.95, "consensus_revenue_next_low": c("revenue") * 0.9, "consensus_revenue_next_high": c("revenue") * 1.4,
        "n_revenue_analysts": (k % 9).cast("double"), "premiums_earned": c("revenue") * 0.8, "policy_benefits": c("revenue") * (0.62 + k % 5 * 0.1),
        "intangibles": F.when(k % 3 == 0, c("equity") * 0.3), "metric_coverage": 0.42 + k % 7 * 0.1, "data_age_days": 60 + k % 9 * 12, "n_analysts": k % 9,
    })
    rate = F.broadcast(V.risk_free_rate(t.market.select("date", (c("close_adj") / 10).alias("close"))))  # one row
    df = df.join(rate)
    return cut_lineage(df) if written else df


fragment("vx", """SELECT vi.* REPLACE (CASE WHEN vi.business_model = 'bank' AND vi.cik % 4 = 0 THEN 'insurer' ELSE vi.business_model END AS business_model), f.roe, f.eps_growth_1y, f.depreciation_amortization AS depreciation, f.amortization_intangibles, f.share_based_comp,
   vi.price / vi.forward_eps AS forward_pe, vi.forward_eps * vi.shares AS forward_earnings FROM vi JOIN fm4 f ON vi.company_id = f.company_id AND vi.date = f.date""", "vi", "fm4")

# ---- relative value

_MULTIPLES = ["ev_ebit", "ev_ebitda", "ev_revenue", "fcf_yield", "forward_pe", "trailing_pe", "price_to_book"]
_CLAIMS = "(coalesce(net_debt, 0) + coalesce(minority_interest, 0) + coalesce(preferred_equity, 0))"


def _equity(m: str) -> str:
    """Equity value that the multiple ``m`` of kind ``multiple`` implies."""
    whole = [("ev_ebit", "ebit"), ("ev_ebitda", "ebitda"), ("ev_revenue", "revenue")]
    level = [("forward_pe", "forward_earnings"), ("trailing_pe", "net_income"), ("price_to_book", "equity")]
    arms = [f"WHEN '{k}' THEN CASE WHEN {d} > 0 THEN {m} * {d} - {_CLAIMS} END" for k, d in whole] + [f"WHEN '{k}' THEN CASE WHEN {d} > 0 THEN {m} * {d} END" for k, d in level]
    return f"CASE multiple WHEN 'fcf_yield' THEN CASE WHEN {m} > 1e-9 AND free_cash_flow > 0 THEN free_cash_flow / {m} END {' '.join(arms)} END"


_SIDE = "CASE a.pkind WHEN 'industry' THEN a.industry = b.industry ELSE a.sector = b.sector END"
fragment("cl", f"""SELECT company_id, date, industry, sector, pkind, m.multiple, m.x FROM (SELECT *, unnest([{', '.join(f"{{'multiple': '{k}', 'x': CASE WHEN {k} > 0 THEN {k} END}}" for k in _MULTIPLES)}]) AS m
   FROM (SELECT vx.*, pkind FROM vx JOIN (SELECT company_id, date, pkind FROM pk) USING (company_id, date)))""", "vx", "pk")
fragment("cp", f"""SELECT a.company_id, a.date, a.multiple, b.x FROM cl a JOIN cl b ON a.date = b.date AND a.multiple = b.multiple AND a.company_id <> b.company_id AND {_SIDE} WHERE b.x IS NOT NULL""", "cl")
fragment("cq", "SELECT company_id, date, multiple, count(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, quantile_cont(x, 0.2) AS a, quantile_cont(x, 0.8) AS b FROM cp GROUP BY 1, 2, 3 HAVING count(*) >= 6", "cp")
fragment("cm", "SELECT company_id, date, multiple, any_value(q1) AS q1, any_value(q3) AS q3, median(x) AS med FROM cp JOIN cq USING (company_id, date, multiple) WHERE x BETWEEN a AND b GROUP BY 1, 2, 3", "cp", "cq")
fragment("cj", """SELECT company_id, date, greatest(least(
   CASE WHEN ng >= 5 AND sg IS NOT NULL THEN 0.10 * greatest(least((sg - mg) / greatest(CASE WHEN dg > 1e-9 THEN dg ELSE 0.05 END, 0.01), 2), -2) ELSE 0 END + CASE WHEN nm >= 5 AND sm IS NOT NULL THEN 0.08 * greatest(least((sm - mm) / greatest(CASE WHEN dm > 1e-9 THEN dm ELSE 0.03 END, 0.01), 2), -2) ELSE 0 END, 0.3), -0.3) AS adjustment FROM qa""", "qa")


def _adjusted(m: str) -> str:
    return f"(CASE WHEN multiple = 'fcf_yield' THEN {m} / (1 + coalesce(adjustment, 0)) ELSE {m} * (1 + coalesce(adjustment, 0)) END)"


fragment("cr", f"""SELECT * FROM (SELECT company_id, date, multiple, adjustment, {_equity(_adjusted('med'))} / shares AS value, {_equity(_adjusted('q1'))} / shares AS e1, {_equity(_adjusted('q3'))} / shares AS e2 FROM cm JOIN vx USING (company_id, date) LEFT JOIN cj USING (company_id, date)
   WHERE shares > 0 AND CASE WHEN business_model IN ('bank', 'insurer') THEN multiple IN ('price_to_book', 'trailing_pe', 'forward_pe') WHEN business_model = 'cyclical' THEN multiple IN ('ev_revenue', 'price_to_book', 'ev_ebitda', 'ev_ebit')
     WHEN business_model = 'unprofitable_growth' THEN multiple IN ('ev_revenue', 'fcf_yield') ELSE multiple IN ('ev_ebit', 'ev_ebitda', 'fcf_yield', 'forward_pe') END) WHERE value > 0""", "cm", "vx", "cj")
fragment("rel", """SELECT company_id, date, median(value) AS value_per_share, CASE WHEN count(*) = 1 THEN min(least(e1, e2)) ELSE min(value) END AS value_low, CASE WHEN count(*) = 1 THEN max(greatest(e1, e2)) ELSE max(value) END AS value_high, any_value(adjustment) AS adjustment, count(*) AS n_multiples
   FROM (SELECT *, bool_or(near) OVER g AS any_near FROM (SELECT *, value BETWEEN mid / 4 AND mid * 4 AS near FROM (SELECT *, median(value) OVER g AS mid FROM cr WINDOW g AS (PARTITION BY company_id, date))) WINDOW g AS (PARTITION BY company_id, date)) WHERE near OR NOT any_near GROUP BY 1, 2""", "cr")


@query("va10_peer_value", f"{{{{with rel}}}} SELECT company_id, date, {R('value_per_share', 4)} AS value_per_share, {R('value_low', 4)} AS value_low, {R('value_high', 4)} AS value_high, {R('adjustment', 4)} AS adjustment, n_multiples FROM rel")
def _(t):
    return rounded(V.comparables(valued_panel(t, written=False)), 4)


# ---- subjects and projections

fragment("s2", """SELECT company_id, date, coalesce(own, median(own) OVER (PARTITION BY date, sector), CASE WHEN bk > 0.1 AND bk < 20 THEN bk END) AS s2c FROM (SELECT *, coalesce(CASE WHEN c5 > 0.1 AND c5 < 20 THEN c5 END, CASE WHEN c3 > 0.1 AND c3 < 20 THEN c3 END, CASE WHEN c1 > 0.1 AND c1 < 20 THEN c1 END) AS own
   FROM (SELECT *, CASE WHEN revenue > revenue__lag5y AND sp > 0 THEN (revenue - revenue__lag5y) / (5 * sp) END AS c5, CASE WHEN revenue > revenue__lag3y AND sp > 0 THEN (revenue - revenue__lag3y) / (3 * sp) END AS c3, CASE WHEN revenue > revenue__lag1y AND sp > 0 THEN (revenue - revenue__lag1y) / sp END AS c1,
     CASE WHEN revenue > 0 AND invested_capital > 0 THEN revenue / invested_capital END AS bk FROM (SELECT *, greatest(coalesce(capex, 0), 0) + greatest(coalesce(acquisitions, 0), 0) AS sp FROM vi)))""", "vi")
fragment("ap", """SELECT *, CASE WHEN l1 > 0 AND m1 > 0 AND m1 < 0.9 THEN m1 END AS cm1, CASE WHEN l2 > 0 AND m2 > 0 AND m2 < 0.9 THEN m2 END AS cm2, greatest(least(revenue * 0.9 / coalesce(l2, l1), 1.0), 0.4) AS lr, greatest(least(revenue * 1.4 / coalesce(l2, l1), 2.5), 1.0) AS hr FROM (SELECT *,
     consensus_eps * shares / (1 - tx) / l1 - CASE WHEN added > 0 AND revenue > 0 THEN added / revenue ELSE 0 END AS m1, forward_eps * shares / (1 - tx) / l2 - CASE WHEN added > 0 AND revenue > 0 THEN added / revenue ELSE 0 END AS m2 FROM (
     SELECT x.*, s2c, hm, hg, k, CASE WHEN y > 0.001 AND y < 0.2 THEN y ELSE 0.042 END AS rf, x.cik % 9 AS na, forward_eps * 0.95 AS consensus_eps, greatest(least(coalesce(tax_rate, 0.21), 0.6), 0) AS tx, coalesce(amortization_intangibles, 0) + coalesce(share_based_comp, 0) AS added,
       CASE WHEN x.cik % 4 <> 3 AND revenue > 0 THEN revenue * (1.02 + x.cik % 5 * 0.03) END AS l1, CASE WHEN x.cik % 4 < 2 AND revenue > 0 THEN revenue * (1.05 + x.cik % 5 * 0.06) END AS l2,
       CASE WHEN growth_rate IS NULL AND eps_growth_1y IS NULL THEN 0.03 ELSE greatest(least(coalesce(0.45 * growth_rate + 0.55 * eps_growth_1y, growth_rate, eps_growth_1y), 0.4), -0.25) END AS ge0
     FROM (SELECT * FROM vx QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY date DESC) = 1) x LEFT JOIN s2 USING (company_id, date) LEFT JOIN (SELECT company_id, median(operating_margin) AS hm, median(growth_rate) AS hg, count(operating_margin) AS k FROM vi GROUP BY 1) USING (company_id),
       (SELECT arg_max(close, date) / 1000 AS y FROM mk)))""", "vx", "s2", "vi", "mk")

# name, growth multiple, margin shift, fade strength, terminal shift, rate shift, side, then changes of growth, margin, rate, capital
_VARIANTS = [(a, b, c, d, e, f, side, 0.0, 0.0, 0.0, 1.0) for a, b, c, d, e, f, side in V.SCENARIOS] + [
    (name, 1.0, 0.0, 1.0, 0.0, 0.0, "mid", *moved)
    for name, moved in {
        "Revenue growth|low": (-0.03, 0.0, 0.0, 1.0), "Revenue growth|high": (0.03, 0.0, 0.0, 1.0), "Operating margin|low": (0.0, -0.02, 0.0, 1.0), "Operating margin|high": (0.0, 0.02, 0.0, 1.0),
        "Discount rate|low": (0.0, 0.0, 0.01, 1.0), "Discount rate|high": (0.0, 0.0, -0.01, 1.0), "Reinvestment intensity|low": (0.0, 0.0, 0.0, 0.75), "Reinvestment intensity|high": (0.0, 0.0, 0.0, 1.25),
    }.items()
]
_COE = "greatest(least({rf} + greatest(least(beta, 2.0), 0.6) * 0.05 + {x} + CASE WHEN market_cap < 1e10 THEN 0.01 ELSE 0 END, 0.16), 0.055)"
fragment("pj", f"""WITH RECURSIVE a AS (SELECT * REPLACE (operating_margin + dm AS operating_margin, cm1 + dm AS cm1, cm2 + dm AS cm2, l1 * moved AS l1, l2 * moved AS l2), {_COE.format(rf='rf + dr', x='rs')} AS rate, greatest(least((ge0 + dg) * gm, 0.4), -0.25) AS g0,
     CASE WHEN tax_rate <> 0 THEN greatest(least(tax_rate, 0.35), 0.10) ELSE 0.21 END AS tax, greatest(least(coalesce(CASE WHEN s2c * fc <> 0 THEN s2c * fc END, 2.0 * fc), 6.0), 0.8) AS sc, CASE side WHEN 'low' THEN lr WHEN 'high' THEN hr ELSE 1 END AS far
     FROM (SELECT *, CASE WHEN l1 IS NOT NULL AND na >= 5 THEN 1 + dg ELSE 1 END AS moved FROM ap, (VALUES {', '.join(str(v) for v in _VARIANTS)}) v(variant, gm, ms, fs, ts, rs, side, dg, dm, dr, fc)) v
     WHERE revenue > 0 AND shares > 0 AND operating_margin IS NOT NULL),
   b AS (SELECT *, least(0.025 + ts, 0.035, rate - 0.01) AS ge, l1 * CASE WHEN l2 IS NOT NULL THEN 1 + (far - 1) / 2 ELSE far END AS c1, l2 * far AS c2 FROM a),
   c AS (SELECT *, CASE WHEN na >= 5 AND coalesce(c2, c1) > revenue THEN CASE WHEN l2 IS NOT NULL THEN 2 ELSE 1 END ELSE 0 END AS h FROM b),
   d AS (SELECT *, CASE WHEN h = 2 AND cm1 IS NOT NULL AND cm2 IS NOT NULL THEN 2 WHEN h = 1 AND cm1 IS NOT NULL THEN 1 ELSE 0 END AS mh, least(cm1, operating_margin + 0.25) AS k1, least(cm2, operating_margin + 0.25) AS k2,
     CASE h WHEN 2 THEN least(c2 / c1 - 1, 0.4) WHEN 1 THEN least(c1 / revenue - 1, 0.4) ELSE g0 END AS gp FROM c),
   e AS (SELECT *, CASE mh WHEN 2 THEN k2 WHEN 1 THEN k1 ELSE operating_margin END AS ml FROM d),
   y AS (SELECT company_id, variant, 0 AS t, revenue AS r, 0.0::DOUBLE AS fcf, 0.0::DOUBLE AS nopat, 0.0::DOUBLE AS pv FROM e UNION ALL
     SELECT company_id, variant, t + 1, r * (1 + g), n - sp, n, (n - sp) / pow(1 + rate, t + 1) FROM (SELECT *, r * (1 + g) * m * (1 - tax) AS n, greatest(r * (1 + g) - r, 0) / sc AS sp FROM (
       SELECT y.company_id, y.variant, y.t, y.r, e.tax, e.sc, e.rate, CASE WHEN t = 0 AND h >= 1 THEN c1 / r - 1 WHEN t = 1 AND h = 2 THEN c2 / r - 1 ELSE gp + (ge - gp) * pow((t + 1 - h) / (10.0 - h), 1 / fs) END AS g,
         CASE WHEN t = 0 AND mh >= 1 THEN k1 WHEN t = 1 AND mh = 2 THEN k2 ELSE ml + ms * least((t + 1 - mh) / 5.0, 1) END AS m FROM y JOIN e USING (company_id, variant) WHERE t < 10))),
   z AS (SELECT company_id, variant, sum(pv) AS pv, max(CASE WHEN t = 10 THEN nopat END) AS np, max(CASE WHEN t = 1 THEN fcf END) AS f1 FROM y GROUP BY 1, 2)
   SELECT *, (ev - {_CLAIMS}) / shares AS v, CASE WHEN ev > 1e-9 THEN tpv / ev END AS terminal_share, coalesce(free_cash_flow > 0 AND f1 < 0 AND (free_cash_flow - f1) / revenue > 0.1, false) AS contradicts, ev <= 0 AS gone FROM (
     SELECT e.*, f1, np * (1 + ge) * (1 - greatest(least(ge / CASE WHEN roic > rate THEN least(roic, rate + 0.05) ELSE rate + 0.01 END, 0.9), 0)) / (rate - ge) / pow(1 + rate, 10) AS tpv, pv + tpv AS ev FROM e JOIN z USING (company_id, variant))""", "ap")


@query("va6_consensus_scenarios", f"""{{{{with pj}}}} SELECT company_id, variant AS scenario, h AS years_of_consensus, {R('v', 4)} AS value_per_share, {R('terminal_share', 5)} AS terminal_share FROM pj WHERE variant IN ('bear', 'base', 'bull')""")
def _(t):
    df = AP.prepared(valued_panel(t)).drop("terminal_share")
    out = V.run_scenarios(df)
    near = lambda year, level: F.abs(F.get("years", F.lit(year))["revenue"] / F.col(level) - 1) < 1e-9
    far = F.when(F.col("side") == "low", F.col("low_ratio")).when(F.col("side") == "high", F.col("high_ratio")).otherwise(1.0)
    out = out.withColumns({"_two": F.col("level_2") * far, "_one": F.col("level_1") * far})
    used = F.when(near(1, "_two"), 2).when(F.col("level_2").isNull() & near(0, "_one"), 1).otherwise(0)
    return rounded(out.select("company_id", "scenario", used.alias("years_of_consensus"), "value_per_share", "terminal_share"), 4, terminal_share=5)


fragment("sw", """SELECT company_id, split_part(variant, '|', 1) AS assumption, max(CASE WHEN variant LIKE '%|low' THEN v END) AS low_value, max(CASE WHEN variant LIKE '%|high' THEN v END) AS high_value FROM pj WHERE contains(variant, '|') GROUP BY 1, 2""", "pj")
fragment("sx", "SELECT s.*, b.v AS base_value, CASE WHEN abs(b.v) > 1e-9 THEN abs(high_value - low_value) / abs(b.v) END AS swing_pct FROM sw s JOIN (SELECT company_id, v FROM pj WHERE variant = 'base') b USING (company_id)", "sw", "pj")


@query("va9_swings", f"{{{{with sx}}}} SELECT company_id, assumption, {R('low_value', 4)} AS low_value, {R('high_value', 4)} AS high_value, {R('base_value', 4)} AS base_value, {R('swing_pct', 4)} AS swing_pct FROM sx")
def _(t):
    return rounded(V.sensitivity(AP.prepared(valued_panel(t)).drop("terminal_share", "contradicts_fcf", "ev_negative"), ["company_id"]), 4)


# ---- methods and their blend


def _excess(book: str, roe: str, growth: float) -> str:
    """Book value plus ten fading years of returns above ``coe``."""
    years = " + ".join(f"pow({1 + growth}, {t - 1}) * (greatest(least({roe}, 0.4), -0.3) - coe) * {1 - (t - 1) / 10} / pow(1 + coe, {t})" for t in range(1, 11))
    return f"CASE WHEN {book} > 0 AND shares > 0 AND {roe} IS NOT NULL THEN {book} * (1 + {years}) / shares END"


fragment("hx", f"""SELECT company_id, {_equity('typical')} / shares AS v, list_position(['ev_ebit', 'ev_ebitda', 'trailing_pe', 'price_to_book'], multiple) AS place FROM (SELECT company_id, multiple, median(x) AS typical FROM (SELECT *, count(*) OVER g AS n, quantile_cont(x, 0.1) OVER g AS a, quantile_cont(x, 0.9) OVER g AS b
   FROM cl WHERE x IS NOT NULL AND multiple IN ('ev_ebit', 'ev_ebitda', 'trailing_pe', 'price_to_book') WINDOW g AS (PARTITION BY company_id, multiple)) WHERE n >= {MIN_HISTORY} AND x BETWEEN a AND b GROUP BY 1, 2) JOIN ap USING (company_id)""", "cl", "ap")
fragment("ohv", "SELECT company_id, arg_min(v, place) AS v FROM hx WHERE v IS NOT NULL GROUP BY 1", "hx")
_WEIGHTS = ", ".join(f"('{m}', '{k}', {w})" for m, ws in V.METHOD_WEIGHTS.items() for k, w in ws.items())
fragment("mv", f"""SELECT *, CASE WHEN halve THEN w0 * 0.5 ELSE w0 END AS weight, CASE WHEN value IS NULL THEN CASE method WHEN 'dcf' THEN 'no projection' WHEN 'comparables' THEN 'no usable peer multiple' WHEN 'historical' THEN 'no usable history' ELSE 'no sector value' END
     WHEN method = 'dcf' AND contradicts THEN 'contradicts reported cash flow' WHEN method = 'dcf' AND gone THEN 'no value in the business' WHEN NOT value / price BETWEEN 0.05 AND 10 THEN 'implausible against the price' END AS reason FROM (
   SELECT *, value IS NOT NULL AND method = 'historical' AND (coalesce(abs(growth_rate - hg) > 0.15, false) OR coalesce(abs(operating_margin - hm) > 0.08, false)) AS halve FROM (
   SELECT q.*, w.method, w.weight AS w0, contradicts, gone, CASE WHEN w.method = 'comparables' THEN rel.value_low END AS low, CASE WHEN w.method = 'comparables' THEN rel.value_high END AS high, CASE w.method WHEN 'dcf' THEN pj.v WHEN 'comparables' THEN rel.value_per_share WHEN 'historical' THEN ohv.v
     WHEN 'residual_income' THEN CASE WHEN q.business_model = 'insurer' THEN {_excess('q.equity', 'CASE WHEN loss > 1 THEN coalesce(q.roe, 0) - least((loss - 1) * 0.5, 0.05) ELSE q.roe END', 0.03).replace('shares', 'q.shares')} ELSE {_excess('tangible', 'q.roe', 0.02).replace('shares', 'q.shares')} END
     WHEN 'nav_affo' THEN CASE WHEN q.shares > 0 AND affo > 0 THEN CASE WHEN ffo / 0.055 - q.net_debt > 0 THEN 0.6 * affo * 18 + 0.4 * (ffo / 0.055 - q.net_debt) ELSE affo * 18 END / q.shares END
     ELSE CASE WHEN q.shares > 0 AND q.revenue > 0 AND q.revenue * mid > 0 THEN (q.revenue * mid * 12 - coalesce(q.net_debt, 0)) / q.shares END END AS value
   FROM (SELECT *, (0.62 + cik % 5 * 0.1) / 0.8 AS loss, CASE WHEN equity > 0 THEN CASE WHEN cik % 3 = 0 THEN greatest(equity - equity * 0.3, equity * 0.2) ELSE equity END END AS tangible, net_income + depreciation AS ffo, net_income + depreciation - coalesce(capex, depreciation * 0.15) AS affo,
     coalesce(CASE WHEN k >= 8 THEN hm END, operating_margin) AS mid, {_COE.format(rf='rf', x="CASE WHEN business_model = 'unprofitable_growth' THEN 0.015 ELSE 0 END")} AS coe FROM ap) q JOIN (VALUES {_WEIGHTS}) w(business_model, method, weight) ON q.business_model = w.business_model
   LEFT JOIN (SELECT company_id, v, contradicts, gone FROM pj WHERE variant = 'base') pj ON q.company_id = pj.company_id LEFT JOIN rel ON q.company_id = rel.company_id AND q.date = rel.date LEFT JOIN ohv ON q.company_id = ohv.company_id))""", "ap", "pj", "rel", "ohv")


@query("va16_methods", f"{{{{with mv}}}} SELECT company_id, method, {R('weight')} AS weight, {R('value', 4)} AS value, {R('low', 4)} AS low, {R('high', 4)} AS high, reason IS NULL AS usable, halve, reason FROM mv")
def _(t):
    return rounded(AP.appraise(valued_panel(t), min_observations=MIN_HISTORY)[0], 4, weight=6)


fragment("ab", """SELECT *, CASE WHEN n_methods > 1 AND abs(base) > 1e-9 THEN std / abs(base) END AS dispersion, coalesce(du AND db / dbase BETWEEN 0.2 AND 1 AND dt / dbase BETWEEN 1 AND 3, false) AS sane FROM (SELECT company_id, date, price, business_model, cik, n_methods, base, std, mn, mx, lo, hi, coalesce(du, false) AS du, db, dbase, dt, dshare, worst FROM ap
   LEFT JOIN (SELECT company_id, count(*) AS n_methods, sum(value * weight) / sum(weight) AS base, stddev_pop(value) AS std, min(value) AS mn, max(value) AS mx, max(low) AS lo, max(high) AS hi, bool_or(method = 'dcf') AS du FROM mv WHERE reason IS NULL GROUP BY 1) USING (company_id)
   LEFT JOIN (SELECT company_id, max(CASE variant WHEN 'bear' THEN v END) AS db, max(CASE variant WHEN 'base' THEN v END) AS dbase, max(CASE variant WHEN 'bull' THEN v END) AS dt, max(CASE variant WHEN 'base' THEN terminal_share END) AS dshare FROM pj GROUP BY 1) USING (company_id)
   LEFT JOIN (SELECT company_id, max(swing_pct) AS worst FROM sx GROUP BY 1) USING (company_id))""", "ap", "mv", "pj", "sx")
fragment("ad", """SELECT *, (bull - bear) / abs(base) AS wd, base / price - 1 AS upside FROM (SELECT *, CASE WHEN n_methods > 1 THEN least(r1, r2, mn, base) ELSE least(r1, r2, base) END AS bear, CASE WHEN n_methods > 1 THEN greatest(r1, r2, mx, base) ELSE greatest(r1, r2, base) END AS bull FROM (
   SELECT *, CASE WHEN sane THEN base * db / dbase WHEN alone THEN lo ELSE base * (1 - bd) END AS r1, CASE WHEN sane THEN base * dt / dbase WHEN alone THEN hi ELSE base * (1 + bd) END AS r2 FROM (
   SELECT *, coalesce(n_methods = 1 AND lo < hi, false) AS alone, least(greatest(coalesce(dispersion, 0), CASE WHEN n_methods > 1 THEN 0.2 ELSE 0.35 END), 0.6) AS bd FROM ab)))""", "ab")
fragment("af", """SELECT *, CASE WHEN base IS NULL THEN 0 ELSE CASE WHEN n_methods = 1 OR dispersion IS NULL THEN 0.7 WHEN dispersion > 0.5 THEN 0.55 WHEN dispersion > 0.25 THEN 0.8 ELSE 1 END::DOUBLE * CASE WHEN wd > 1.5 THEN 0.5 WHEN wd > 1 THEN 0.7 WHEN wd > 0.7 THEN 0.88 ELSE 1 END * CASE WHEN du AND worst > 1 THEN 0.6 WHEN du AND worst > 0.5 THEN 0.8 ELSE 1 END
   * CASE WHEN du AND dshare IS NULL THEN 0.6 WHEN du AND dshare > 0.85 THEN 0.7 WHEN du AND dshare > 0.8 THEN 0.88 ELSE 1 END * CASE WHEN 0.42 + cik % 7 * 0.1 < 0.5 THEN 0.65 WHEN 0.42 + cik % 7 * 0.1 < 0.75 THEN 0.85 ELSE 1 END * CASE WHEN 60 + cik % 9 * 12 > 130 THEN 0.8 ELSE 1 END * CASE WHEN cik % 9 < 5 THEN 0.9 ELSE 1 END
   * CASE business_model WHEN 'unprofitable_growth' THEN 0.65 WHEN 'cyclical' THEN 0.85 ELSE 1 END END AS confidence, greatest(least(coalesce(wd / 0.6, 1), 2), 0.5) AS sp FROM ad""", "ad")
_AP = ["base", "bear", "bull", "dispersion", "upside", "confidence"]


@query("va16_appraisal", f"""{{{{with af}}}} SELECT company_id, business_model, coalesce(n_methods, 0) AS n_methods, {', '.join(f'{R(x, 4)} AS {x}' for x in _AP)}, CASE WHEN upside IS NULL OR confidence < 0.35 THEN 'insufficient_confidence' WHEN upside >= 0.3 * sp THEN 'significantly_undervalued' WHEN upside >= 0.12 * sp THEN 'undervalued'
   WHEN upside <= -0.3 * sp THEN 'significantly_overvalued' WHEN upside <= -0.12 * sp THEN 'overvalued' ELSE 'fairly_valued' END AS classification,
   array_to_string(list_filter([CASE WHEN base IS NULL THEN 'no valuation method could run' END, CASE WHEN n_methods = 1 THEN 'only one method' END, CASE WHEN dispersion > 0.25 THEN 'methods disagree' END, CASE WHEN base IS NOT NULL AND NOT sane AND NOT alone THEN 'generic range' END, CASE WHEN 60 + cik % 9 * 12 > 130 THEN 'old financials' END,
     CASE WHEN business_model = 'cyclical' THEN 'cyclical earnings' END, CASE WHEN business_model = 'unprofitable_growth' THEN 'not yet profitable' END], lambda x: x IS NOT NULL), '; ') AS caveats FROM af""")
def _(t):
    out = AP.appraise(valued_panel(t), min_observations=MIN_HISTORY)[1]
    return rounded(out.select("company_id", "business_model", F.coalesce("n_methods", F.lit(0)).alias("n_methods"), *_AP, "classification", F.array_join("caveats", "; ").alias("caveats")), 4)
