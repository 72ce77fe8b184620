import datetime as dt

import pytest

from panelstone.functions.spec import CATEGORY_WEIGHTS, FEATURES, METRICS, Metric
from panelstone.operators import scoring as S

DATE = dt.date(2024, 1, 31)


def panel(spark, values, sector="S", industry="I", model="operating"):
    rows = []
    for i, v in enumerate(values):
        pick = lambda x, i=i: x[i] if isinstance(x, (list, tuple)) else x
        rows.append((f"c{i:02d}", f"T{i}", DATE, pick(sector), pick(industry), pick(model), v))
    return spark.createDataFrame(rows, "company_id string, ticker string, date date, sector string, industry string, business_model string, m double")


def metric(direction=1, basis="universe", min_peers=2, models=("operating",)):
    return (Metric("m", "quality", direction, 1.0, basis, models, 0.0, min_peers),)


@pytest.mark.parametrize("split", [False, True])
def test_direction_missing_and_not_applicable(spark, split):
    score = lambda df, **k: {r.company_id: r for r in S.score_metrics(S.add_peer_keys(df), metric(**k), split=split).collect()}
    up = score(panel(spark, [1.0, 2.0, 3.0, 4.0]))
    assert [up[f"c{i:02d}"].score for i in range(4)] == [12.5, 37.5, 62.5, 87.5]
    down = score(panel(spark, [1.0, 2.0, 3.0, 4.0]), direction=-1)
    assert [down[f"c{i:02d}"].score for i in range(4)] == [87.5, 62.5, 37.5, 12.5]
    gap = score(panel(spark, [1.0, None, 3.0]))
    assert gap["c01"].status == "missing" and gap["c01"].score is None and gap["c00"].peer_count == 2
    mixed = score(panel(spark, [1.0, 2.0, 3.0], model=["operating", "bank", "operating"]))
    assert mixed["c01"].status == "not_applicable" and mixed["c00"].peer_count == 2


@pytest.mark.parametrize("split", [False, True])
def test_thin_industries_fall_back_and_hopeless_groups_say_so(spark, split):
    df = S.add_peer_keys(panel(spark, [float(i) for i in range(6)], industry=["A", "A", "A", "A", "B", "B"]))
    got = {r.company_id: r for r in S.score_metrics(df, metric(basis="industry", min_peers=4), split=split).collect()}
    assert got["c00"].peer_basis == "industry" and got["c00"].peer_count == 4
    assert got["c04"].peer_basis == "sector" and got["c04"].peer_count == 6
    lonely = {r.company_id: r for r in S.score_metrics(df, metric(basis="industry", min_peers=50), split=split).collect()}
    assert {r.status for r in lonely.values()} == {"thin_peers"} and {r.peer_basis for r in lonely.values()} == {"universe"}


def test_category_coverage_and_renormalisation(spark):
    rows = [("c", "T", DATE, "quality", "scored", 80.0, 0.3), ("c", "T", DATE, "quality", "missing", None, 0.7), ("c", "T", DATE, "growth", "scored", 60.0, 0.5), ("c", "T", DATE, "growth", "not_applicable", None, 0.5),
            ("c", "T", DATE, "momentum", "scored", 40.0, 1.0)]
    ms = spark.createDataFrame(rows, "company_id string, ticker string, date date, category string, status string, score double, weight double")
    cats = {r.category: r for r in S.build_category_scores(ms).collect()}
    assert cats["quality"].score is None and cats["growth"].score == 60.0 and cats["growth"].coverage == 1.0
    out = S.build_opportunity_scores(S.build_category_scores(ms)).collect()[0]
    assert out.score == pytest.approx((60 * 0.25 + 40 * 0.25) / 0.5) and out.coverage == pytest.approx(0.5) and out["rank"] == 1


def test_declared_specification_is_whole():
    assert len(METRICS) == 43 and abs(sum(CATEGORY_WEIGHTS.values()) - 1) < 1e-9 and len(FEATURES) == 37
    for category in CATEGORY_WEIGHTS:
        assert abs(sum(m.weight for m in METRICS if m.category == category) - 1) < 1e-6
