"""Joins whose sides grow with the input leave the driver alone, however small the files look."""

import pytest
from pyspark.sql import functions as F

from panelstone.operators import verdicts as VD
from panelstone.sources import contracts as C
from panelstone.sources import registry as RG
from panelstone.sources import tables as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gates_broadcast_the_declared_table_only(spark, tmp_path):
    spark.range(50).write.parquet(str(tmp_path / "runs"))
    cells = F.array(*[F.struct(F.lit(g[1]).alias("metric"), F.col("id").cast("double").alias("value")) for g in VD.RESULT_GATES])
    m = spark.read.parquet(str(tmp_path / "runs")).select(F.concat(F.lit("r"), "id").alias("run_id"), F.explode(cells).alias("_m")).select("run_id", "_m.*")
    out = VD.evaluate_gates(m, VD.RESULT_GATES)
    assert plan(out).count("BroadcastHashJoin") == 1 and "SortMergeJoin" in plan(out)
    assert out.count() == 50 * len(VD.RESULT_GATES) and out.where("passed").count() == sum(49 - int(g[2] - 1e-9) if g[2] else 50 for g in VD.RESULT_GATES)


@pytest.fixture
def planned(spark, monkeypatch):
    plans, kind = [], type(spark.range(0))
    empty = kind.isEmpty
    monkeypatch.setattr(kind, "isEmpty", lambda df: plans.append(plan(df)) or empty(df))
    return plans


def trials(spark, start, end, params="p"):
    rows = spark.range(start, end).select(F.concat(F.lit("O"), "id").alias("trial_id"), F.lit("s").alias("strategy"), F.lit("d").alias("period"), F.lit(params).alias("params"))
    return C.coerce(rows, C.TABLES["experiments"])


def test_recorded_keys_are_not_broadcast(spark, tmp_path, planned):
    root = str(tmp_path)
    S.append(trials(spark, 0, 30), root, "experiments")
    S.append(trials(spark, 30, 40), root, "experiments")
    with pytest.raises(ValueError, match="already recorded"):
        S.append(trials(spark, 39, 41), root, "experiments")
    assert RG.record(trials(spark, 35, 45), root, "experiments") == 5
    with pytest.raises(ValueError, match="other content"):
        RG.record(trials(spark, 0, 2, "q"), root, "experiments")
    assert S.scan(spark, root, "experiments").count() == 45
    joined = [p for p in planned if "Join" in p]
    assert joined and not any("BroadcastHashJoin" in p for p in joined)
