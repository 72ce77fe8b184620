"""Peer statistics come from a few order statistics of each group; the rows of the panel are not moved for them."""

import datetime as dt
import random

import numpy as np
import pytest

from panelstone.operators import valuation as V

DAY = dt.date(2024, 6, 28)


def brute(x, trim, q):
    x = np.array(x)
    kept = x
    if trim and len(x) >= 5:
        lo, hi = np.quantile(x, [trim, 1 - trim])
        kept = x[(x >= lo) & (x <= hi)]
    return np.median(kept), np.quantile(x, q), x.std()


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("trim", [0.0, 0.2])
def test_ties_at_every_edge_match_brute_force(spark, trim, split):
    rng = random.Random(4)
    choices = [[1.0, 2.0], [1.0, 1.0, 2.0, 3.0], [-1.0, 0.0, 0.5, 4.0, 4.0, 4.0, 9.0], [x / 7 for x in range(40)]]
    rows = [(g, i, rng.choice([None, *choices[g % 4], *choices[g % 4]])) for g in range(60) for i in range(1 + g // 4)]
    df = spark.createDataFrame(rows, "g int, id int, v double")
    got = V.leave_one_out(df, ["g"], "v", trim, {"a": 0.25, "b": 0.75}, split=split).collect()
    assert len(got) == len(rows)
    for r in got:
        x = [v for g, i, v in rows if g == r.g and i != r.id and v is not None]
        assert r.loo_n == len(x)
        if not x:
            assert r.loo_median is None and r.a is None and r.loo_std is None
            continue
        median, (a, b), std = brute(x, trim, [0.25, 0.75])
        assert (r.loo_median, r.a, r.b) == (pytest.approx(median), pytest.approx(a), pytest.approx(b)), (r, sorted(x))
        assert r.loo_std == pytest.approx(std, abs=1e-6)


def panel(spark):
    """A sector with a large and two small industries, one whose industries are all large, companies without industry or sector."""
    rng = random.Random(7)
    names = ["A1"] * 9 + ["A2"] * 3 + ["A3"] * 2 + [None] * 2 + ["B1"] * 8 + ["B2"] * 7 + ["C1"]
    sector = {"A": "A", "B": "B", "C": None}
    rows = []
    for day in range(3):
        for i, name in enumerate(names):
            x = [rng.choice([None, -1.0, 5.0, 5.0, rng.uniform(1, 30)]) for _ in range(4)]
            rows.append((f"c{i:02d}", DAY + dt.timedelta(days=day), name, sector[name[0]] if name else "A", "operating", 100.0, *x))
    return spark.createDataFrame(rows, "company_id string, date date, industry string, sector string, business_model string, shares double, ev_ebit double, ev_ebitda double, growth double, margin double"), rows


def test_peers_of_mixed_kinds_match_brute_force(spark):
    df, rows = panel(spark)
    chosen = V.choose_peer_group(df)
    got = V.peer_statistics(chosen, ["ev_ebit", "ev_ebitda"], 0.2, {"q": 0.25}, carried=("shares",)).collect()
    assert len(got) == 2 * len(rows) and all(r.shares == 100.0 for r in got)
    by = {(r[0], r[1]): r for r in rows}
    for r in got:
        me, at = by[r.company_id, r.date], 6 if r.multiple == "ev_ebit" else 7
        industry = me[2] is not None and sum(o[1] == r.date and o[2] == me[2] for o in rows) > 6
        assert r.kind == ("industry" if industry else "sector")
        k = 2 if industry else 3
        x = [o[at] for o in rows if o[1] == r.date and o[0] != r.company_id and me[k] is not None and o[k] == me[k] and o[at] is not None and o[at] > 0]
        assert r.loo_n == len(x)
        if x:
            median, a, _ = brute(x, 0.2, 0.25)
            assert r.loo_median == pytest.approx(median) and r.q == pytest.approx(a)


def test_only_chosen_groups_are_ranked(spark):
    df, _ = panel(spark)
    groups = V.peer_groups(V.choose_peer_group(df), ["ev_ebit"], 0.2)
    assert {(r.kind, r.grp) for r in groups.collect()} == {("industry", "A1"), ("industry", "B1"), ("industry", "B2"), ("sector", "A")}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_the_panel_is_not_moved(spark):
    df, rows = panel(spark)
    chosen = V.choose_peer_group(df)
    out = V.quality_adjustment(chosen)
    assert exchanges(out) == 0 and out.count() == len(rows)
    assert exchanges(V.peer_statistics(out, ["ev_ebit", "ev_ebitda"], 0.2, {"q": 0.25})) == 0


def test_comparables_write_only_what_they_use(spark, monkeypatch):
    df, _ = panel(spark)
    written = []
    cut = V.cut_lineage
    monkeypatch.setattr(V, "cut_lineage", lambda x: (written.append(x.columns), cut(x))[1])
    wide = df.withColumns({f"other_{i}": df["ev_ebit"] for i in range(5)} | {"ebit": df["shares"]})
    assert V.comparables(wide).count() > 0
    assert not any(x.startswith("other_") for columns in written for x in columns)
