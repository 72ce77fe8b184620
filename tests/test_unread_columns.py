"""What nobody reads is neither computed nor moved: ranks, and the fields of peer groups."""

from datetime import date

from pyspark.sql import functions as F

from panelstone.functions.spec import METRICS
from panelstone.operators import scoring as S
from panelstone.operators.ranking import add_ordinal_rank

USED = tuple(m for m in METRICS if m.key in ("roic", "mom_12_1"))


def panel(spark):
    rows = [(f"c{i}", f"T{i}", date(2020, 1 + i % 2, 28), f"s{i % 2}", f"i{i % 3}", "operating", float(i % 17), None if i % 5 == 0 else i / 7, i * 3.0) for i in range(90)]
    names = "company_id string, ticker string, date date, sector string, industry string, business_model string, roic double, mom_12_1 double, market_cap double"
    return spark.createDataFrame(rows, names)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_rank_that_nobody_reads_is_left_out(spark):
    df = panel(spark)
    ranked = add_ordinal_rank(df, ["date"], "market_cap", "company_id", "r")
    assert "Join" in optimized(ranked)
    assert "Join" not in optimized(ranked.drop("r")) and "Window" not in optimized(ranked.drop("r"))
    assert sorted(ranked.drop("r").collect()) == sorted(df.collect())
    peers = optimized(S.add_peer_keys(df).drop("peer_size_decile"))
    assert "Join" not in peers and "Window" not in peers


def test_categories_take_only_scores_through_the_sorts(spark):
    scores = S.build_metric_scores(panel(spark), USED)
    whole, narrow = optimized(scores), optimized(S.build_category_scores(scores))
    for unread in ("_mid", "_win", "_med_a", "_size_rank"):
        assert unread not in narrow
    assert "_med_a" in whole and "_win" in whole
    got = {(r.metric, r.company_id): r for r in scores.collect()}
    assert len(got) == 180 and {r.peer_basis for r in got.values()} == {"industry", "universe"}
    assert all((r.peer_count is None or r.peer_count >= 8) and r.peer_group is not None for r in got.values())


def test_ranks_of_scores(spark):
    scores = panel(spark).select("company_id", "ticker", "date", F.col("roic").alias("quality"), F.col("mom_12_1").alias("score"))
    ranked = S.rank_scores(scores)
    out = {r.company_id: r for r in ranked.collect()}
    for d in (date(2020, 1, 28), date(2020, 2, 28)):
        rows = [r for r in out.values() if r.date == d]
        order = sorted((r for r in rows if r.score is not None), key=lambda r: (-r.score, r.company_id))
        assert [r["rank"] for r in order] == list(range(1, len(order) + 1))
        assert {r.universe_size for r in rows} == {45}
        assert all(r["rank"] is None and r.percentile is None and r.band == "Not scored" for r in rows if r.score is None)
