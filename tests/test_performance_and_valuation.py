import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstone.operators import evaluate as E
from panelstone.operators import performance as PM
from panelstone.operators import portfolio as PF
from panelstone.operators import valuation as V

DAY = dt.date(2020, 1, 1)


def path(spark, values, run="r", step=1):
    return spark.createDataFrame([(run, DAY + dt.timedelta(days=i * step), float(v), 100.0 + i) for i, v in enumerate(values)], "run_id string, date date, equity double, benchmark double")


def test_basic_statistics(spark):
    r = [x["ret"] for x in PM.add_equity_returns(path(spark, [100, 110, 99])).orderBy("date").collect()]
    assert r[0] is None and r[1:] == [pytest.approx(0.1), pytest.approx(-0.1)]
    two_years = spark.createDataFrame([("r", dt.date(2020, 1, 1), 1.0), ("r", dt.date(2021, 12, 31), 2.0)], "run_id string, date date, equity double")
    got = PM.basic_statistics(two_years).collect()[0]
    assert got.cagr == pytest.approx(2 ** (365.25 / 730) - 1)
    flat = PM.basic_statistics(path(spark, [100] * 5)).collect()[0]
    assert flat.volatility == 0 and flat.sharpe is None and flat.calmar is None


def test_longest_drawdown_counts_the_open_one(spark):
    got = PM.drawdown_duration(path(spark, [100, 90, 101, 95, 94, 96, 97])).collect()[0]
    assert (got.start, got.trough, got.recovered, got.days) == (DAY + dt.timedelta(days=2), DAY + dt.timedelta(days=4), None, 4)


def test_bootstrap_is_repeatable_and_brackets_the_truth(spark):
    rng = np.random.default_rng(2)
    eq = lambda s: 100 * np.exp(np.cumsum(np.random.default_rng(s).normal(0.0004, 0.01, 400)))
    df = path(spark, eq(1), "a").unionByName(path(spark, eq(2), "b"))
    one = {r.run_id: r for r in PM.bootstrap_intervals(df, samples=150).collect()}
    two = {r.run_id: r for r in PM.bootstrap_intervals(df.repartition(5), samples=150).collect()}
    assert set(one) == {"a", "b"} and PM.bootstrap_intervals(df, samples=150).count() == 2
    for k in one:
        assert one[k].sharpe_low == pytest.approx(two[k].sharpe_low) and one[k].sharpe_low < one[k].sharpe_high
        truth = PM.basic_statistics(df.where(F.col("run_id") == k)).collect()[0].sharpe
        assert one[k].sharpe_low < truth < one[k].sharpe_high
    assert rng is not None


def test_deflation_lowers_with_more_trials(spark):
    eq = 100 * np.exp(np.cumsum(np.random.default_rng(5).normal(0.001, 0.01, 500)))
    m = PM.return_moments(path(spark, eq))
    probs = [PM.deflated_sharpe(m, n).collect()[0].probability for n in (1, 10, 1000)]
    assert probs[0] > probs[1] > probs[2]
    row = m.collect()[0]
    z = row.sr * math.sqrt(row.n - 1) / math.sqrt(1 - row.skew * row.sr + (row.kurtosis - 1) / 4 * row.sr**2)
    assert probs[0] == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))), abs=1e-9)


def test_expanding_bands_only_see_the_past(spark):
    df = spark.createDataFrame([(DAY + dt.timedelta(days=i), 0.10 if i < 15 else 0.90) for i in range(30)], "date date, v double")
    got = E.expanding_bands(df, "v").orderBy("date").collect()
    assert all(r.v_high is None for r in got[:9]) and got[14].v_high == pytest.approx(0.10) and got[-1].v_high > 0.10


def test_equal_weights_cap_and_ties(spark):
    rows = [(DAY, f"s{i}", "x" if i < 3 else "y", 5.0) for i in range(6)]
    df = spark.createDataFrame(rows, "date date, security_id string, sector string, score double")
    names = sorted(r.security_id for r in PF.select_names(df, 4, 0.5).collect())
    assert names == ["s0", "s1", "s3", "s4"]
    w = PF.add_weights(PF.select_names(df, 4), max_position_weight=0.1).collect()
    assert sum(r.weight for r in w) == pytest.approx(0.4)


def test_leave_one_out_matches_brute_force(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.7 else f"g{i % 4}", i, rng.choice([None, 1.0, 1.0, 2.0, rng.random() * 5, rng.random() * 5])) for i in range(150)]
    df = spark.createDataFrame(rows, "g string, id int, v double")
    for split in (False, True):
        for trim in (0.0, 0.2):
            for r in V.leave_one_out(df, ["g"], "v", trim, {"a": 0.25}, split=split).collect():
                x = np.array([v for g, i, v in rows if g == r.g and i != r.id and v is not None])
                assert r.loo_n == len(x)
                if not len(x):
                    continue
                assert r.a == pytest.approx(np.quantile(x, 0.25))
                if trim and len(x) >= 5:
                    lo, hi = np.quantile(x, [trim, 1 - trim])
                    x = x[(x >= lo) & (x <= hi)]
                assert r.loo_median == pytest.approx(np.median(x))


def company(spark, **kw):
    base = dict(company_id="c", date=DAY, revenue=1000.0, operating_margin=0.2, tax_rate=0.21, shares=100.0, net_debt=0.0, growth_rate=0.05, sales_to_capital=2.0, roic=0.15, beta=1.0, market_cap=2e10, business_model="operating")
    base.update(kw)
    cols = {k: ("date" if k == "date" else "string" if isinstance(v, str) else "double") for k, v in base.items()}
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {t}" for k, t in cols.items()))


def base_value(df):
    return V.run_scenarios(df).where("scenario = 'base'").collect()[0]


def test_projection_by_hand_and_orderings(spark):
    r = base_value(company(spark))
    rate, g_end, revenue, pv = 0.042 + 0.05, 0.025, 1000.0, 0.0
    for t in range(1, 11):
        g = 0.05 + (g_end - 0.05) * t / 10
        prev, revenue = revenue, revenue * (1 + g)
        nopat = revenue * 0.2 * 0.79
        pv += (nopat - max(revenue - prev, 0) / 2.0) / (1 + rate) ** t
    terminal = nopat * (1 + g_end) * (1 - g_end / min(0.15, rate + 0.05)) / (rate - g_end) / (1 + rate) ** 10
    assert r.value_per_share == pytest.approx((pv + terminal) / 100.0)
    by = {x.scenario: x.value_per_share for x in V.run_scenarios(company(spark)).collect()}
    assert by["bear"] < by["base"] < by["bull"]
    assert base_value(company(spark, operating_margin=0.25)).value_per_share > r.value_per_share > base_value(company(spark, beta=1.6)).value_per_share
    assert V.run_scenarios(company(spark, revenue=-1.0)).count() == 0


def test_sensitivity_surrounds_the_base(spark):
    got = {r.assumption: r for r in V.sensitivity(company(spark), ["company_id"]).collect()}
    assert set(got) == {"Revenue growth", "Operating margin", "Discount rate", "Reinvestment intensity"}
    for r in got.values():
        assert min(r.low_value, r.high_value) < r.base_value < max(r.low_value, r.high_value) and r.swing_pct > 0


def test_comparables_blend_the_peers(spark):
    rows = [(f"c{i:02d}", DAY, "I", "S", "operating", 10.0, 100.0, 100.0, 0.0, 0.1, 0.2) for i in range(12)]
    df = spark.createDataFrame(rows, "company_id string, date date, industry string, sector string, business_model string, ev_ebit double, ebit double, shares double, net_debt double, growth double, margin double")
    got = V.comparables(df).collect()
    assert len(got) == 12 and all(r.value_per_share == pytest.approx(10.0) and r.n_multiples == 1 for r in got)
