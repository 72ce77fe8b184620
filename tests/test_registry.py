import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelstone.sources import registry as RG
from panelstone.sources import tables as T
from panelstone.sources.contracts import TABLES, coerce

NOW = dt.datetime(2024, 1, 1)


def trial(spark, rows):
    return spark.createDataFrame(rows, "trial_id string, recorded_at timestamp, strategy string, period string, params string")


def test_ids_follow_content(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", "x"), ("a", "x"), ("a\"", "x")], "s string, p string").select(RG.content_id("run", "s", "p").alias("id"))
    ids = [r.id for r in df.collect()]
    assert len(set(ids)) == 4 and ids[2] == ids[3] and all(i.startswith("run-") and len(i) == 36 for i in ids)


def test_a_trial_is_recorded_once_for_ever(spark, tmp_path):
    root = str(tmp_path)
    assert RG.trials_by_strategy(spark, root).count() == 0
    assert RG.record(trial(spark, [("t1", NOW, "s", "development", "{}"), ("t2", NOW, "s", None, None)]), root, "experiments") == 2
    later = NOW + dt.timedelta(days=1)
    assert RG.record(trial(spark, [("t1", later, "s", "development", "{}"), ("t2", later, "s", None, None), ("t3", later, "r", "x", "{}")]), root, "experiments") == 1
    with pytest.raises(ValueError, match="t2"):
        RG.record(trial(spark, [("t2", NOW, "s", "validation", None), ("t4", NOW, "s", "x", "{}")]), root, "experiments")
    audit = spark.createDataFrame([("a1", NOW, "s", "final"), ("a2", NOW, "q", "final")], "access_id string, accessed_at timestamp, strategy string, reason string")
    assert [RG.record(audit, root, "holdout_audit") for _ in range(2)] == [2, 0]
    got = {r.strategy: (r.n_trials, r.n_holdout) for r in RG.trials_by_strategy(spark, root).collect()}
    assert got == {"s": (2, 1), "r": (1, 0), "q": (0, 1)}
    kept = {r.trial_id: r.recorded_at for r in T.read(spark, root, "experiments").collect()}
    assert kept == {"t1": NOW, "t2": NOW, "t3": later}
    with pytest.raises(ValueError, match="duplicate"):
        RG.record(trial(spark, [("t9", NOW, "s", "x", "{}"), ("t9", NOW, "s", "y", "{}")]), root, "experiments")
    with pytest.raises(ValueError):
        RG.record(audit, root, "backtest_runs")


def test_seven_kinds_saved_twice_give_one_row_each(spark, tmp_path):
    root = str(tmp_path)
    rows = {}
    for name in RG.RESULTS:
        spec = TABLES[name]
        cells = {f.name: F.lit("k").cast(f.dataType) if f.dataType.typeName() == "string" else F.lit(None).cast(f.dataType) for f in spec.schema}
        fill = {"date": F.lit("2024-01-01").cast("date"), "horizon": F.lit(1)}
        cells.update({k: v for k, v in fill.items() if k in cells})
        rows[name] = coerce(spark.range(1).select(*[c.alias(k) for k, c in cells.items()]), spec)
    for _ in range(2):
        RG.save_results(rows, root)
    assert {name: T.read(spark, root, name).count() for name in RG.RESULTS} == dict.fromkeys(RG.RESULTS, 1)
    with pytest.raises(ValueError):
        RG.save_results({"experiments": rows["backtest_runs"]}, root)
