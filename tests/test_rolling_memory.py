"""A chain of rolling statistics sorts its rows once, in parts whose number grows with the input; long windows are exact."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstone import session
from panelstone.operators.prices import BY, ON, add_consistency, add_trend
from panelstone.operators.rolling import Roll, rolling, rolling_extreme
from panelstone.operators.signals import rolling_regression, signal_features, technical_features

DAY = dt.date(2020, 1, 6)


def frame(spark, values, names):
    return spark.createDataFrame([("A", DAY + dt.timedelta(days=i), *v) for i, v in enumerate(values)], "ticker string, date date, " + ", ".join(f"{n} double" for n in names))


def sorts(df):
    return sum(line.strip(" :+-*()0123456789").startswith("Sort [") for line in df._jdf.queryExecution().executedPlan().toString().splitlines())


def test_a_chain_of_windows_sorts_once(spark):
    df = frame(spark, [(1.0, 1.0, 1.0, 1.0, 1.0, 1.0)] * 5, ["close", "close_adj", "ret_1d", "mkt_ret", "volume", "dollar_volume"])
    assert sorts(add_consistency(add_trend(df, "close_adj"))) == 1
    assert sorts(technical_features(df)) == 1
    assert sorts(signal_features(df.withColumn("rv_range_close", F.col("close")), "ticker", "date")) == 1
    assert sorts(rolling_regression(df.withColumnsRenamed({"mkt_ret": "mkt_ret_1d"}).withColumn("sector_ret_1d", F.col("close")), "ticker", "date", two_factor=True)) == 1


@pytest.mark.parametrize("window", [65, 66, 67, 126])
def test_long_windows_match_brute_force(spark, window):
    rng = np.random.default_rng(window)
    x, y = rng.normal(5, 1, 300), rng.normal(0, 1, 300)
    x[0] = 1e12
    known = rng.random(300) > 0.1
    df = frame(spark, [(float(a) if k else None, float(b)) for a, b, k in zip(x, y, known)], ["x", "y"])
    v, u = F.col("x"), F.col("y")
    specs = [Roll("n", "mean", v, window, 20), Roll("s", "sum", v, window, 20), Roll("sd", "std", v, window, 20), Roll("b", "beta", v, window, 20, y=u, full=True)]
    out = rolling_extreme(rolling(df, BY, ON, specs), BY, ON, "y", window, "hi").orderBy("date").collect()
    for i in (30, window - 1, window, 200, 299):
        w = slice(max(0, i - window + 1), i + 1)
        a, b = x[w][known[w]], y[w][known[w]]
        tight = {"rel": 1e-9} if i >= window else {"rel": 1e-3}
        assert out[i].n == pytest.approx(a.mean(), **tight) and out[i].s == pytest.approx(a.sum(), **tight) and out[i].sd == pytest.approx(a.std(ddof=1), **tight)
        if i + 1 < window:
            assert out[i].b is None and out[i].hi is None
        else:
            assert out[i].hi == y[w].max() and (i < window or out[i].b == pytest.approx(np.cov(a, b, ddof=0)[0, 1] / b.var(), rel=1e-6))


def test_parts_grow_with_the_files(spark, tmp_path, monkeypatch):
    spark.range(20000).selectExpr("id", "rand(1) x").repartition(2).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert session.dealt(df, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "PART_BYTES", 10000)
    out = session.dealt(df, "id")
    assert out.rdd.getNumPartitions() == -(-size // 10000) and out.count() == 20000


def test_signals_are_dealt_before_their_structs_are_sorted(spark, tmp_path):
    from panelstone.operators.ingest import dedupe_signals

    spark.range(40).selectExpr("concat('u', id % 10) uid", "id value", "'k' kind").write.parquet(str(tmp_path / "s"))
    out = dedupe_signals(spark.read.parquet(str(tmp_path / "s")))
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in text and "ENSURE_REQUIREMENTS" not in text
    assert {(r.uid, r.value) for r in out.collect()} == {(f"u{i}", 30 + i) for i in range(10)}
