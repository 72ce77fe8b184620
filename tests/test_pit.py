import datetime as dt

from panelstone.operators import pit as P

SCHEMA = "company_id string, concept string, start date, end date, filed date, available_at date, value double, accession string, tag_rank int"
Q = [(dt.date(2020, 1, 1), dt.date(2020, 3, 31)), (dt.date(2020, 4, 1), dt.date(2020, 6, 30)), (dt.date(2020, 7, 1), dt.date(2020, 9, 30)), (dt.date(2020, 10, 1), dt.date(2020, 12, 31))]


def fact(start, end, value, lag=40, rank=0, acc=None):
    filed = end + dt.timedelta(days=lag)
    return ("c", "revenue", start, end, filed, filed + dt.timedelta(days=1), float(value), acc or f"{end}-{lag}", rank)


def ttm(spark, rows):
    return sorted(((r.available_at, r.period_end, r.value, r.n_sources) for r in P.ttm_series(spark.createDataFrame(rows, SCHEMA)).collect()))


def test_discrete_quarters_and_year_to_date_cuts_agree(spark):
    values = [100, 110, 120, 130]
    discrete = [fact(s, e, v) for (s, e), v in zip(Q, values)]
    cuts = [fact(Q[0][0], e, sum(values[: i + 1])) for i, (_, e) in enumerate(Q)]
    for rows in (discrete, cuts):
        out = ttm(spark, rows)
        assert [(x[1], x[2], x[3]) for x in out] == [(Q[3][1], 460.0, 4)]
        assert out[0][0] == Q[3][1] + dt.timedelta(days=41)


def test_a_missing_quarter_gives_no_value(spark):
    assert ttm(spark, [fact(*Q[0], 100), fact(*Q[1], 110), fact(*Q[3], 130)]) == []


def test_annual_only_filer(spark):
    out = ttm(spark, [fact(Q[0][0], Q[3][1], 460)])
    assert [(x[2], x[3]) for x in out] == [(460.0, 1)]


def test_restatement_is_a_new_date_not_a_rewrite(spark):
    rows = [fact(s, e, v) for (s, e), v in zip(Q, [100, 110, 120, 130])] + [fact(*Q[1], 115, lag=300)]
    out = ttm(spark, rows)
    assert [x[2] for x in out] == [460.0, 465.0] and out[0][0] < out[1][0]


def test_preferred_tag_wins_within_a_filing(spark):
    rows = [fact(s, e, v, rank=1, acc="g") for (s, e), v in zip(Q, [100, 110, 120, 130])] + [fact(*Q[3], 131, rank=0, acc="s")]
    assert [x[2] for x in ttm(spark, rows)] == [461.0]


def test_scale_guard(spark):
    start = dt.date(2017, 1, 1)
    rows = []
    for i in range(12):
        s = start + dt.timedelta(days=91 * i)
        rows.append(fact(s, s + dt.timedelta(days=90), 4433.0 if i == 6 else 4.4e9))
    flagged = P.flag_scale_outliers(spark.createDataFrame(rows, SCHEMA)).where("scale_outlier").collect()
    assert [r.value for r in flagged] == [4433.0]
    # A step change agrees with the quarters after it and survives.
    step = [(*r[:6], 4e6 if i < 6 else 5.5e8, *r[7:]) for i, r in enumerate(rows)]
    assert P.flag_scale_outliers(spark.createDataFrame(step, SCHEMA)).where("scale_outlier").count() == 0


def test_instants_use_the_newest_period_and_levels_are_not_summed(spark):
    e1, e2 = Q[0][1], Q[1][1]
    inst = [fact(None, e1, 5.0), fact(None, e2, 6.0), fact(None, e1, 5.5, lag=200)]
    out = sorted((r.available_at, r.value) for r in P.instant_series(spark.createDataFrame(inst, SCHEMA)).collect())
    assert [v for _, v in out] == [5.0, 6.0]
    levels = [fact(*Q[0], 1000), fact(*Q[1], 1010), fact(Q[0][0], Q[1][1], 1005)]
    out = sorted((r.available_at, r.value) for r in P.latest_level_series(spark.createDataFrame(levels, SCHEMA)).collect())
    assert [v for _, v in out] == [1000.0, 1010.0]


def test_a_long_history_keeps_every_slice(spark):
    """Seven years of year-to-date quarters: every slice is a quarter, and a restatement older than five years still counts."""
    rows, ends = [], [(3, 31), (6, 30), (9, 30), (12, 31)]
    for year in range(2012, 2019):
        rows += [fact(dt.date(year, 1, 1), dt.date(year, *e), 100 * (i + 1)) for i, e in enumerate(ends)]
    rows.append(fact(dt.date(2012, 1, 1), dt.date(2012, 3, 31), 90, lag=2600))
    known = P.known_periods(spark.createDataFrame(rows, SCHEMA))
    newest = known.agg({"as_of": "max"}).first()[0]
    slices = {(r.start, r.end): r.value for r in P.decompose(known.where(known["as_of"] == newest), ["company_id", "concept", "as_of"]).collect()}
    assert len(slices) == 28 and max((e - s).days for s, e in slices) < 100
    assert slices[dt.date(2012, 1, 1), dt.date(2012, 3, 31)] == 90 and slices[dt.date(2012, 9, 30), dt.date(2012, 12, 31)] == 100


def test_a_broken_table_is_not_an_absent_one(spark, tmp_path):
    import pytest

    from panelstone.sources import contracts, tables

    spec = next(iter(contracts.TABLES.values()))
    assert tables.read(spark, str(tmp_path), spec) is None
    folder = tmp_path / spec.layer / spec.name
    folder.mkdir(parents=True)
    (folder / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        tables.read(spark, str(tmp_path), spec).count()
