"""Signals are reduced to one row per uid: ids travel as bytes where they are such, equal rows become one before they move."""

import random

from pyspark.sql import functions as F

from panelstone.operators.ingest import dedupe_signals
from panelstone.session import dealt

IDS = ["00ff", "00FF", "0ff", "", " 00ff", "x1", "é", None, "ab" * 32, "AB" * 32, "ab" * 31 + "ax"]


def signals(spark):
    draw = random.Random(3)
    rows = [(draw.choice(IDS), draw.choice("ab"), draw.choice("kl"), draw.choice([None, 1.0, 2.0, -1.5, float("nan")]), draw.randint(1, 3)) for _ in range(400)]
    return rows, spark.createDataFrame(rows + rows, "uid string, entity string, kind string, value double, n int").repartition(5)


def expected(rows, first):
    rank = lambda v: (0, 0) if v is None else (2, 0) if v != v else (1, v)  # noqa: E731 - null first, not-a-number last
    best = {}
    for uid, entity, kind, value, n in rows:
        order = (*([n] if first else []), entity, kind, rank(value), *([] if first else [n]))
        best[uid] = max(best.get(uid, (order,)), (order,))
    return {u: o[0] for u, o in best.items()}


def test_ids_of_any_text_stay_apart(spark):
    rows, df = signals(spark)
    rank = lambda v: (0, 0) if v is None else (2, 0) if v != v else (1, v)
    for near in (False, True):
        for sequence in ((), ("n",)):
            out = dedupe_signals(dealt(df, "entity") if near else df, sequence, near=near)
            assert out.columns == df.columns
            got = out.collect()
            assert len(got) == len(IDS)
            want = expected(rows, bool(sequence))
            for r in got:
                here = (r.n, r.entity, r.kind, rank(r.value)) if sequence else (r.entity, r.kind, rank(r.value), r.n)
                assert here == want[r.uid], (near, sequence, r)


def test_negative_zero_stays(spark):
    df = spark.createDataFrame([("a", "x", -0.0)] * 2, "uid string, entity string, value double")
    for near in (False, True):
        assert [str(r.value) for r in dedupe_signals(df, near=near).collect()] == ["-0.0"]


def test_equal_rows_meet_before_they_move(spark, tmp_path):
    ids = spark.range(4000).select(F.sha2(F.col("id").cast("string"), 256).alias("uid"), (F.col("id") % 50).cast("string").alias("entity"), F.lit(1.0).alias("value"))
    ids.write.parquet(str(tmp_path / "s"))
    s = spark.read.parquet(str(tmp_path / "s"))
    plan = dedupe_signals(dealt(s.union(s), "entity"), near=True)._jdf.queryExecution().executedPlan().toString().splitlines()
    moves = [i for i, x in enumerate(plan) if "Exchange hashpartitioning" in x]
    assert len(moves) == 2 and "entity" in plan[moves[1]]
    assert any("HashAggregate(keys=[_b" in x for x in plan[moves[0] : moves[1]])  # between the two moves, by all columns
    assert "uid" not in plan[moves[0]]
