import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelstone.operators import asof as A
from panelstone.operators import membership as M

D = lambda m, d, y=2020: dt.date(y, m, d)


def test_asof_is_inclusive_and_keeps_a_matched_null(spark):
    left = spark.createDataFrame([("a", D(1, 5)), ("a", D(1, 10)), ("a", D(1, 1)), ("b", D(1, 9))], "k string, date date")
    right = spark.createDataFrame([("a", D(1, 5), 1.0), ("a", D(1, 8), None)], "k string, at date, v double")
    for bucket in (None, F.trunc("_at", "WEEK"), F.col("_at")):
        got = {(r.k, r.date): (r.v, r.at) for r in A.asof_backward(left, right, ["k"], "date", "at", {"v": "v", "at": "at"}, bucket=bucket).collect()}
        assert got[("a", D(1, 5))] == (1.0, D(1, 5))
        assert got[("a", D(1, 10))] == (None, D(1, 8))
        assert got[("a", D(1, 1))] == got[("b", D(1, 9))] == (None, None)
    strict = {r.date: r.v for r in A.asof_backward(left.where("k = 'a'"), right, ["k"], "date", "at", {"v": "v"}, strict=True).collect()}
    assert strict[D(1, 5)] is None


def test_late_facts_never_reach_back(spark):
    grid = spark.createDataFrame([("c", D(3, 1)), ("c", D(6, 1))], "company_id string, date date")
    facts = spark.createDataFrame([("c", "revenue", D(2, 1), 10.0), ("c", "revenue", D(5, 1), 20.0), ("c", "equity", D(5, 1), 3.0)], "company_id string, concept string, available_at date, value double")
    got = {r.date: r for r in A.attach_wide(grid, facts, ["revenue", "equity"]).collect()}
    assert (got[D(3, 1)].revenue, got[D(3, 1)].equity, got[D(3, 1)].revenue__asof) == (10.0, None, D(2, 1))
    assert (got[D(6, 1)].revenue, got[D(6, 1)].equity) == (20.0, 3.0)


def test_forward_returns(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    rows = [("AAA", d, 100.0 + i) for i, d in enumerate(days)] + [("SPY", d, 50.0) for d in days]
    px = spark.createDataFrame(rows, "ticker string, date date, close_adj double")
    dec = spark.createDataFrame([("AAA", days[0]), ("AAA", days[50])], "ticker string, date date")
    got = {r.date: r for r in A.horizon_returns(dec, px, px.select("date").distinct(), [1], "SPY").collect()}
    assert got[days[0]].fwd_1m == pytest.approx(0.21) and got[days[0]].excess_1m == pytest.approx(0.21)
    assert got[days[50]].fwd_1m is None


def snaps(spark, present):
    months = [D(1, 31), D(2, 29), D(3, 31), D(4, 30), D(5, 31), D(6, 30)]
    rows = [(t, months[i], None) for t, idx in present.items() for i in idx]
    return spark.createDataFrame(rows, "ticker string, snapshot_date date, date_added date"), months


def test_rejoining_makes_two_spells(spark):
    df, m = snaps(spark, {"AAA": [0, 1, 4, 5], "BBB": range(6)})
    got = sorted((r.ticker, r.entry_observed_by, r.exit_observed_by, r.still_member) for r in M.build_spans(df).collect())
    assert got == [("AAA", m[0], m[2], False), ("AAA", m[4], None, True), ("BBB", m[0], None, True)]


def test_one_primary_class_whatever_the_input_order(spark):
    rows = [("IDX", "s1", "GOOG", D(1, 31), "none", 9), ("IDX", "s1", "GOOGL", D(1, 31), "full", 3), ("IDX", "s2", "B", D(1, 31), "full", 3), ("IDX", "s2", "A", D(1, 31), "full", 3)]
    schema = "index_name string, security_id string, ticker string, entry_observed_by date, price_coverage string, n_snapshots int"
    for data in (rows, rows[::-1]):
        primary, other = M.collapse_share_classes(spark.createDataFrame(data, schema))
        assert sorted(r.ticker for r in primary.collect()) == ["A", "GOOGL"] and other.count() == 2


def test_members_on_dates_collapse_overlaps_and_leave_on_exit(spark):
    spells = spark.createDataFrame([("s", D(1, 10), D(3, 31)), ("s", D(2, 1), None)], "security_id string, entry_date date, exit_date date")
    dates = spark.createDataFrame([(D(1, 9),), (D(1, 31),), (D(2, 29),), (D(3, 31),)], "date date")
    got = sorted(r.date for r in M.membership_on_dates(spells, dates).collect())
    assert got == [D(1, 31), D(2, 29), D(3, 31)]


def test_coverage_classes(spark):
    rows = [(None, None, D(1, 1), None), (D(1, 1), D(12, 31), D(2, 1), D(5, 1)), (D(3, 1), D(12, 31), D(2, 1), D(5, 1)), (D(1, 1), D(12, 31), D(1, 1, 1990), D(1, 1, 1991))]
    df = spark.createDataFrame(rows, "f date, l date, a date, b date")
    day = lambda x: F.lit(str(x)).cast("date")
    got = [r[0] for r in df.select(M.classify_coverage("f", "l", "a", "b", day(D(1, 1)), day(D(12, 31)))).collect()]
    assert got == ["none", "full", "partial", "none"]


def test_business_models(spark):
    cases = [("Financials", "Regional Banks", "bank"), ("Financials", "Asset Management & Custody Banks", "operating"), ("Real Estate", "Retail REITs", "reit"), ("Real Estate", "Real Estate Services", "operating"),
             ("Energy", "x", "cyclical"), ("Industrials", "Passenger Airlines", "cyclical"), ("Technology", "Software", "operating"), (None, None, "operating")]
    df = spark.createDataFrame(cases, "s string, i string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", M.classify_business_model("s", "i")).collect())
