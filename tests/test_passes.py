"""Rolling statistics on arrays of ordered rows: equal to the planner's windows, and in one pass."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelstone.operators import prices as P
from panelstone.operators.passes import ordered
from panelstone.operators.rolling import Roll, add_positive, add_rolling_median, add_shift, rolling, rolling_drawdown, rolling_extreme

BY, ON = ["k"], "d"


@pytest.fixture(scope="module")
def series(spark):
    draw = random.Random(5)
    rows = []
    for k, n in (("a", 1), ("b", 9), ("c", 70), ("d", 320), ("e", 533), (None, 40)):
        for i in range(n):
            x = draw.choice([None, float("nan"), float("inf")]) if draw.random() < 0.06 else draw.uniform(-1, 2)
            if (k, i) == ("e", 3):
                x = 1e15  # a large early value leaves later frames exact
            p = None if draw.random() < 0.02 else draw.choice([draw.uniform(5, 9), 7.0, 0.0, -1.0] if k == "c" else [draw.uniform(5, 9), 7.0])
            rows.append((k, date(2000, 1, 1) + timedelta(days=2 * i), x, None if draw.random() < 0.05 else draw.uniform(-1, 1), p))
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "k string, d date, x double, y double, p double").repartition(3).localCheckpoint()


def chain(df):
    specs = [
        Roll("sum21", "sum", F.col("x") - F.col("y"), 21), Roll("mean50", "mean", F.col("x"), 50, 20), Roll("mean200", "mean", "x", 200, 5),
        Roll("rms", "rms", F.pow(F.least(F.col("x"), F.lit(0.0)), 2), 90, 40, full=True, scale=3.0), Roll("std", "std", "x", 252, 2),
        Roll("std7", "std", "x", 7, 2), Roll("var", "var_pop", F.col("y"), 63, 1), Roll("beta", "beta", "x", 120, 10, y="y", full=True),
        Roll("beta_down", "beta", F.when(F.col("y") < 0, F.col("x")), 252, 4, y=F.when(F.col("y") < 0, F.col("y"))),
    ]
    df = rolling(df, BY, ON, specs)
    df = add_positive(df, "sum21", "won")
    df = rolling(df, BY, ON, [Roll("share", "mean", "won", 30, 10)])
    df = rolling_extreme(rolling_extreme(df, BY, ON, "y", 12, "high"), BY, ON, "p", 100, "low", low=True)
    df = add_shift(add_rolling_median(df, "p", BY, ON, 20, 6, "med"), "mean50", 63, BY, ON, "before")
    df = df.withColumn("ratio", F.col("mean50") / (F.col("before") + 1e-12)).drop("before")
    df = rolling(df, BY, ON, [Roll("ratio5", "sum", F.col("ratio") * 2, 5, 3)])  # needs what the steps before made
    return rolling_drawdown(rolling_drawdown(df, BY, ON, "p", 21, "dd21"), BY, ON, "p", 300, "dd300")


def test_arrays_equal_windows(spark, series):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # entities reach over several batches
    try:
        done = chain(ordered(series, BY, ON)).passed().frame
        got = {(r["k"], r["d"]): r.asDict() for r in done.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = chain(series)
    assert sorted(done.columns) == sorted(plain.columns)
    want = {(r["k"], r["d"]): r.asDict() for r in plain.collect()}
    assert got.keys() == want.keys() and len(got) == 973
    filled = dict.fromkeys(plain.columns, 0)
    for key, row in want.items():
        for name, value in row.items():
            other = got[key][name]
            if isinstance(value, float):
                filled[name] += 1
                same = other is not None and (math.isclose(other, value, rel_tol=1e-8, abs_tol=1e-9) or (math.isnan(value) and math.isnan(other)))
                assert same, (key, name, value, other)
            else:
                assert other == value, (key, name, value, other)
    assert all(filled[x] > 0 for x in plain.columns if x not in BY + [ON])


def test_unordered_rows_are_an_error(spark):
    from panelstone.operators.passes import Ordered, Step

    rows = spark.createDataFrame([("a", 2, 1.0), ("a", 1, 2.0)], "k string, d int, x double").coalesce(1)
    with pytest.raises(Exception, match="not in order"):
        Ordered(rows, BY, ON).after(Step("s", "sum", "x", 2)).passed().frame.collect()
    with pytest.raises(ValueError):
        rolling(ordered(rows, BY, ON), ["x"], ON, [Roll("s", "sum", "x", 2)])


def test_price_metrics_sort_once_and_pass_once(spark):
    days = spark.range(400).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (20 + F.rand(1)).alias("close_adj"))
    prices = days.crossJoin(spark.createDataFrame([("A",), ("B",), ("M",), ("F",)], "ticker string")).withColumns(
        {"close_raw": F.col("close_adj"), "volume": F.lit(5.0), "dollar_volume": F.rand(2)}
    )
    sectors = spark.createDataFrame([("A", "s"), ("B", "s")], "ticker string, sector string")
    plan = P.build_price_metrics(prices, "M", sectors, {"s": "F"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert plan.count("Window [") == 2  # the benchmark's return and the lags; 23 nodes before
