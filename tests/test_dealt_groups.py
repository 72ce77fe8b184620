"""Groups that one task must hold are dealt to parts whose number grows with the input."""

import datetime as dt

from pyspark.sql import functions as F

from panelstone.functions.spec import METRICS
from panelstone.operators import evaluate, pit, scoring

USED = tuple(m for m in METRICS if m.key in ("roic", "ev_ebit", "mom_12_1"))


def panel(spark, dates=8, companies=12):
    rows = [(f"c{i:02}", f"T{i}", dt.date(2020, 1, 1 + d) if d else None, "S", "I", "operating", (i * 7 + d) % 11 / 10, (i * 5 + d) % 13 / 10, i / 10) for d in range(dates) for i in range(companies)]
    return spark.createDataFrame(rows, "company_id string, ticker string, date date, sector string, industry string, business_model string, roic double, ev_ebit double, mom_12_1 double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_task_holds_as_few_dates_of_a_metric_as_there_are_parts(spark, monkeypatch):
    monkeypatch.setattr(scoring, "parts_of", lambda df, size: 24)
    dealt = scoring._dealt_in_turn(scoring.add_peer_keys(panel(spark)), USED)
    held = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("m", F.coalesce("date", F.lit("1970-01-01").cast("date"))).alias("groups"), F.count(F.lit(1)).alias("n")).collect()
    assert len(held) == 24 and {(r.groups, r.n) for r in held} == {(1, 12)}


def test_the_levels_need_no_other_shuffle_and_the_scores_are_as_by_cut_groups(spark):
    keyed = scoring.add_peer_keys(panel(spark)).localCheckpoint()
    out = scoring.score_metrics(keyed, USED)
    assert "REPARTITION_BY_NUM" in plan(out) and "hashpartitioning(_part" not in plan(out) and "hashpartitioning(m" not in plan(out)
    of = lambda df: sorted((r.asDict() for r in df.collect()), key=lambda r: (str(r["date"]), r["company_id"], r["metric"]))
    assert of(out) == of(scoring.score_metrics(keyed, USED, split=True))

def test_fundamentals_are_dealt_by_company_and_concept_once(spark):
    day = lambda m, d=1: dt.date(2020 + (m - 1) // 12, (m - 1) % 12 + 1, d)
    rows = [(f"c{i}", "Revenues", "USD", day(q), day(q + 3), day(q + 4), day(q + 4, 2), 100.0 + i + q, f"a{i}-{q}") for i in range(5) for q in range(1, 25, 3)]
    rows += [(f"c{i}", "Assets", "USD", None, day(q + 3), day(q + 4), day(q + 4, 2), 50.0 + i + q, f"b{i}-{q}") for i in range(5) for q in range(1, 25, 3)]
    seen = spark.createDataFrame(rows, "company_id string, tag string, unit string, period_start date, period_end date, filed date, available_at date, value double, accession string")
    names = spark.createDataFrame([("revenue", "Revenues", "USD", 0, "duration", "sum"), ("assets", "Assets", "USD", 0, "instant", "last")], "concept string, tag string, unit string, tag_rank int, period_type string, aggregation string")
    out = pit.build_fundamentals(seen, names)
    assert "REPARTITION_BY_NUM" in plan(out) and "ENSURE_REQUIREMENTS" not in plan(out)
    got = {(r.company_id, r.concept, r.basis, r.available_at): (r.value, r.n_sources) for r in out.collect()}
    assert len(got) == 5 * 5 + 5 * 8 and got["c2", "revenue", "ttm", day(14, 2)] == (4 * 102 + 1 + 4 + 7 + 10, 4) and got["c3", "assets", "instant", day(5, 2)] == (54.0, 1)


def test_ablations_move_the_rows_of_a_variant_once(spark):
    names = ("quality", "growth", "momentum", "valuation")
    rows = [(f"c{i:02}", dt.date(2020, 1 + d, 1), *[float((i * k + d) % 23) if (i + k) % 9 else None for k in (3, 5, 7, 11)], float(i * 13 % 29), (i * 17 + d) % 31 / 10) for d in range(5) for i in range(30)]
    df = spark.createDataFrame(rows, "company_id string, date date, quality double, growth double, momentum double, valuation double, score double, y double")
    once = evaluate.signal_ic(df, [*names, "score"], {"y": 1}, split=False)
    assert "REPARTITION_BY_NUM" in plan(once) and "ENSURE_REQUIREMENTS" not in plan(once)
    of = lambda df: {(r.signal, r.date): (round(r.ic, 9), r.n) for r in df.collect()}
    assert of(once) == of(evaluate.signal_ic(df, [*names, "score"], {"y": 1})) and len(of(once)) == 25
    assert "REPARTITION_BY_NUM" in plan(evaluate.ablations(df, "y", 1))
