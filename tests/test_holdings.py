import datetime as dt
import random

import pytest

from panelstone.operators import holdings as HD
from panelstone.operators import portfolio as PF
from panelstone.operators import variants as VR

DAY = dt.date(2020, 1, 1)


def day(i):
    return DAY + dt.timedelta(days=i)


def prices_of(spark, table):
    rows = [(k, day(i), v) for k, series in table.items() for i, v in series.items()]
    return spark.createDataFrame(rows, "ticker string, date date, close_adj double")


def calendar(spark, n):
    return spark.createDataFrame([(day(i),) for i in range(n)], "date date")


def weights_of(spark, rows):
    return spark.createDataFrame([(k, day(i), w) for k, i, w in rows], "ticker string, date date, weight double")


def test_every_fate_of_a_holding(spark):
    table = {
        "kept": {1: 10.0, 11: 12.0},
        "late": {2: 10.0, 13: 5.0},  # both prices within two sessions of their execution
        "sold": {1: 10.0, 6: 8.0},  # last price before the next execution
        "lost": {1: 10.0},
        "never": {4: 10.0, 11: 10.0},  # first price three sessions after the execution
        "broken": {1: 0.0, 2: float("nan"), 11: 7.0},
    }
    names = sorted(table)
    w = weights_of(spark, [(k, 0, 1 / 6) for k in names] + [("kept", 10, 0.5)])
    held = PF.holding_returns(w, prices_of(spark, table), calendar(spark, 30), tolerance=2)
    got = {(r.ticker, r.period): (r.state, r.ret) for r in held.collect()}
    assert got == {
        ("kept", 1): ("held", pytest.approx(0.2)), ("late", 1): ("held", pytest.approx(-0.5)), ("sold", 1): ("liquidated", pytest.approx(-0.2)),
        ("lost", 1): ("written_off", -1.0), ("never", 1): ("not_bought", 0.0), ("broken", 1): ("not_bought", 0.0), ("kept", 2): ("open", None),
    }
    first, second = PF.period_returns(w, prices_of(spark, table), calendar(spark, 30), tolerance=2, bps=10.0).orderBy("exec_date").collect()
    gross = (0.2 - 0.5 - 0.2 - 1.0) / 6
    assert first.gross == pytest.approx(gross) and first.turnover == pytest.approx(4 / 6) and first.net == pytest.approx(gross - 4 / 6 / 1000)
    assert (first.date, first.exec_date, first.next_date) == (day(0), day(1), day(11))
    assert (first.n_held, first.n_liquidated, first.n_written_off, first.n_not_bought, first.n_open) == (2, 1, 1, 2, 0)
    drift = {"kept": 1.2, "late": 0.5, "sold": 0.8}  # what is lost needs no sale
    moved = abs(0.5 - 1.2 / 6 / (1 + gross)) + sum(drift[k] / 6 / (1 + gross) for k in ("late", "sold"))
    assert second.gross is None and second.net is None and second.turnover == pytest.approx(moved)


def test_no_price_never_counts_as_no_change(spark):
    w = weights_of(spark, [("a", 0, 1.0), ("b", 10, 1.0)])
    one = PF.period_returns(w, prices_of(spark, {"a": {1: 10.0}, "b": {11: 1.0}}), calendar(spark, 20)).orderBy("exec_date").first()
    assert one.gross == -1.0 and one.n_written_off == 1
    none = PF.period_returns(w.limit(0), prices_of(spark, {"a": {1: 10.0}}), calendar(spark, 20))
    assert none.count() == 0


def test_schedule_shifts_and_delays(spark):
    decisions = spark.createDataFrame([(day(i),) for i in (5, 10, 15)], "date date")
    plans = [("a", 0, 1), ("early", -6, 1), ("late", 4, 2)]
    got = {(r.plan, r.period): (r.date, r.exec_date, r.next_date, len(r.days)) for r in HD.schedule(decisions, calendar(spark, 20), plans, 3).collect()}
    assert got == {
        ("a", 1): (day(5), day(6), day(11), 5), ("a", 2): (day(10), day(11), day(16), 5), ("a", 3): (day(15), day(16), None, 4),
        # six sessions early only the scores of the decision before are known; the first has none
        ("early", 1): (day(5), day(10), None, 4),
        ("late", 1): (day(5), day(11), day(16), 5), ("late", 2): (day(10), day(16), None, 4),
    }


def panel(seed=4, names=40, months=8, step=10):
    rng = random.Random(seed)
    series, ranked = {}, []
    for k in range(names):
        p, path = 50.0, {}
        stop = rng.choice([10**6] * 8 + [rng.randrange(months * step)])
        for i in range(months * step + 12):
            p *= 1 + rng.gauss(0.0008 * (k % 5), 0.02)
            if rng.random() < 0.6 and i < stop:
                path[i] = p
        series[f"n{k:02d}"] = path
        for m in range(months):
            ranked.append(("s", day(m * step + 5), f"n{k:02d}", f"sec{k % 3}", round(k % 5 + rng.random(), 3)))
    return series, ranked


def test_variants_in_one_plan_equal_single_runs(spark):
    series, rows = panel()
    ranked = spark.createDataFrame(rows, "strategy string, date date, ticker string, sector string, score double")
    prices, days = prices_of(spark, series), calendar(spark, 92)
    bench = spark.createDataFrame([(day(i), 100.0 + i % 3) for i in range(92)], "date date, close_adj double")
    variants = (
        VR.Variant("double_costs", "4x", top_n=6, cost_factor=4.0), VR.Variant("execution_delay", "3 days", top_n=6, delay=3),
        VR.Variant("sector_cap", "30%", top_n=6, max_sector_weight=0.34), VR.Variant("weighting", "p", top_n=6, weighting="score_proportional"),
        VR.Variant("threshold", "9 names", top_n=9), VR.Variant("drop_winners", "2", top_n=6, drop_top=2),
    )
    base = VR.Variant("base", "base", top_n=6)
    got = {(r.test): r for r in VR.robustness(ranked, prices, days, bench, variants, base, tolerance=2).collect()}
    assert set(got) == {v.test for v in variants} and all(r.base_excess is not None for r in got.values())

    def single(v, dropped=()):
        r = ranked.where(~ranked.ticker.isin(list(dropped))) if dropped else ranked
        chosen = PF.select_names(r, v.top_n, v.max_sector_weight, entity="ticker")
        w = PF.add_weights(chosen, v.weighting)
        held = PF.holding_returns(w, prices, days, delay=v.delay, tolerance=2).collect()
        periods = PF.period_returns(w, prices, days, delay=v.delay, tolerance=2, bps=PF.ONE_WAY_BPS * v.cost_factor).where("next_date is not null").collect()
        growth, start, end = 1.0, min(p.exec_date for p in periods), max(p.next_date for p in periods)
        for p in periods:
            growth *= 1 + p.net
        return held, growth ** (365.25 / (end - start).days) - 1

    held, _ = single(base)
    total = {}
    for h in held:
        if h.state in HD.BOUGHT:
            total[h.ticker] = total.get(h.ticker, 0.0) + h.weight * h.ret
    best = sorted(total, key=lambda k: (-round(total[k], 9), k))[:2]
    for v in variants:
        assert got[v.test].cagr == pytest.approx(single(v, best if v.drop_top else ())[1]), v.test


def test_windows_are_formed_only_for_names_and_periods_held(spark, monkeypatch):
    """What is reduced to price windows grows with the holdings, not with all names that trade."""
    windows, made = HD.price_windows, []

    def counted(*args):
        out = windows(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(HD, "price_windows", counted)
    table = {f"n{k}": {i: 10.0 + (k + i) % 5 for i in range(40)} for k in range(50)}
    w = weights_of(spark, [("n1", 0, 0.5), ("n2", 0, 0.5), ("n1", 10, 1.0), ("n3", 30, 1.0)])
    held = {(r.ticker, r.period): (r.state, r.ret) for r in PF.holding_returns(w, prices_of(spark, table), calendar(spark, 40)).collect()}
    change = lambda k, a, b: (10.0 + (k + b) % 5) / (10.0 + (k + a) % 5) - 1
    assert held == {
        ("n1", 1): ("held", pytest.approx(change(1, 1, 11))), ("n2", 1): ("held", pytest.approx(change(2, 1, 11))),
        ("n1", 2): ("held", pytest.approx(change(1, 11, 31))), ("n3", 3): ("open", None),
    }
    assert made == [6]  # n1 in all three periods, n2 in two, n3 in the last
