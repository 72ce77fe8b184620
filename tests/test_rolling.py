import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstone.operators.rolling import Roll, rolling, rolling_drawdown, rolling_extreme

DAY = dt.date(2020, 1, 6)


def series(spark, values, name="x", ticker="A"):
    return spark.createDataFrame([(ticker, DAY + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], f"ticker string, date date, {name} double")


def column(df, name):
    return [r[name] for r in df.orderBy("ticker", "date").collect()]


def test_drawdown_keeps_peak_and_trough_in_one_window(spark):
    falling = rolling_drawdown(series(spark, [100.0, 90.0, 80.0, 70.0, 60.0]), ["ticker"], "date", "x", 5, "dd")
    assert column(falling, "dd")[:4] == [None] * 4 and column(falling, "dd")[4] == pytest.approx(-0.40)
    recovered = rolling_drawdown(series(spark, [200.0, 100, 110, 120, 130, 140, 150]), ["ticker"], "date", "x", 5, "dd")
    assert column(recovered, "dd")[-1] == pytest.approx(0.0)


@pytest.mark.parametrize("window", [3, 7, 20])
def test_drawdown_and_extremes_match_brute_force(spark, window):
    x = np.exp(np.cumsum(np.random.default_rng(4).normal(0, 0.05, 83)))
    df = rolling_extreme(rolling_drawdown(series(spark, x.tolist()), ["ticker"], "date", "x", window, "dd"), ["ticker"], "date", "x", window, "hi")
    for i, (dd, hi) in enumerate(zip(column(df, "dd"), column(df, "hi"))):
        if i + 1 < window:
            assert dd is None and hi is None
        else:
            w = x[i + 1 - window : i + 1]
            assert dd == pytest.approx((w / np.maximum.accumulate(w) - 1).min()) and hi == pytest.approx(w.max())


def two(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.normal(0, 0.01, n)
    r = 1.3 * m + rng.normal(0, 0.005, n)
    rows = [("A", DAY + dt.timedelta(days=i), None if i % 17 == 0 else float(r[i]), float(m[i])) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, date date, r double, m double"), r, m


def specs():
    r, m = F.col("r"), F.col("m")
    return [Roll("sd", "std", r, 50, 20), Roll("mean", "mean", r, 50, 20), Roll("beta", "beta", r, 60, 30, y=m, full=True)]


def test_moments_match_numpy_with_gaps(spark):
    df, r, m = two(spark)
    got = rolling(df, ["ticker"], "date", specs()).orderBy("date").collect()
    keep = np.array([i % 17 != 0 for i in range(len(r))])
    for i in (19, 49, 100, 299):
        w = slice(max(0, i - 49), i + 1)
        x = r[w][keep[w]]
        if len(x) >= 20:
            assert got[i].sd == pytest.approx(x.std(ddof=1), rel=1e-6) and got[i].mean == pytest.approx(x.mean(), abs=1e-12)
        else:
            assert got[i].sd is None
    i = 250
    w = slice(i - 59, i + 1)
    x, y = r[w][keep[w]], m[w][keep[w]]
    assert got[i].beta == pytest.approx(np.cov(x, y, ddof=0)[0, 1] / y.var(), rel=1e-6)
    assert got[58].beta is None and got[59].beta is not None


@pytest.mark.parametrize("first", [1e12, 1e200, -5e15])
def test_a_large_early_value_leaves_later_windows_exact(spark, first):
    x = [first] + [1 + i / 1000 for i in range(8)]
    df = series(spark, x).withColumn("y", F.col("x") * 2 + F.pmod(F.dayofmonth("date"), F.lit(3)))
    y = column(df, "y")
    v = F.col("x")
    out = rolling(df, ["ticker"], "date", [Roll("sd", "std", v, 4), Roll("m", "mean", v, 4), Roll("b", "beta", F.col("y"), 4, y=v)])
    sd, m, b = column(out, "sd"), column(out, "m"), column(out, "b")
    for i in range(4, 9):
        w, u = np.array(x[i - 3 : i + 1]), np.array(y[i - 3 : i + 1])
        assert sd[i] == pytest.approx(w.std(ddof=1), rel=1e-9) and m[i] == pytest.approx(w.mean(), rel=1e-14)
        assert b[i] == pytest.approx(np.cov(u, w, ddof=0)[0, 1] / w.var(), rel=1e-6)


def test_truncating_the_future_changes_nothing(spark):
    df, _, _ = two(spark)
    whole = {r.date: (r.sd, r["mean"], r.beta) for r in rolling(df, ["ticker"], "date", specs()).collect()}
    for n in (70, 200):
        part = df.where(F.col("date") < DAY + dt.timedelta(days=n))
        for r in rolling(part, ["ticker"], "date", specs()).collect():
            assert whole[r.date] == (r.sd, r["mean"], r.beta)


def test_a_day_without_volume_does_not_poison_illiquidity(spark):
    rows = [("A", DAY + dt.timedelta(days=i), 0.01, 0.0 if i == 30 else 1e6) for i in range(63)]
    df = spark.createDataFrame(rows, "ticker string, date date, ret_1d double, dollar_volume double").withColumn("mkt_ret", F.lit(0.0))
    from panelstone.operators.prices import risk_rolls

    spec = [s for s in risk_rolls() if s.name == "amihud"]
    assert column(rolling(df, ["ticker"], "date", spec), "amihud")[-1] == pytest.approx(0.01)
