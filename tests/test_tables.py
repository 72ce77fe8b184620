import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelstone.sources import contracts as C
from panelstone.sources import tables as T

SPEC = C.TableSpec("t", "raw", "k string, d date, v double", ("k", "d"), required=("v",), entity="k", date="d")
D = dt.date(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, SPEC.schema)


def test_contract_names_every_problem(spark):
    df = frame(spark, [("a", D, 1.0), ("a", D, 2.0), ("b", D, None)])
    got = {(r.problem, r.subject, r.n) for r in C.validate(df, SPEC).collect()}
    assert got == {("duplicate_key", "a|2024-01-01", 1), ("null_in_required", "v", 1)}
    assert C.schema_problems(df.drop("v").withColumn("x", F.lit(1)), SPEC) == [("missing", "v"), ("extra", "x")]
    with pytest.raises(ValueError):
        C.check(df, SPEC)


def test_write_upsert_append(spark, tmp_path):
    root = str(tmp_path)
    assert T.read(spark, root, SPEC) is None
    T.write(frame(spark, [("a", D, 1.0), ("b", D, 2.0)]), root, SPEC)
    T.upsert(frame(spark, [("b", D, 20.0), ("c", D, 3.0)]), root, SPEC)
    assert {r.k: r.v for r in T.read(spark, root, SPEC).collect()} == {"a": 1.0, "b": 20.0, "c": 3.0}
    with pytest.raises(ValueError):
        T.append(frame(spark, [("a", D, 9.0), ("d", D, 4.0)]), root, SPEC)
    T.append(frame(spark, [("d", D, 4.0)]), root, SPEC)
    assert T.read(spark, root, SPEC).count() == 4


def test_percentages_become_fractions_once(spark):
    df = spark.createDataFrame([(5.0,), (-250.0,), (8.0,), (None,)], "x double")
    once = C.percent_to_fraction(df, "x")
    assert sorted(r.x for r in once.where("x is not null").collect()) == [-2.5, 0.05, 0.08]
    assert sorted(r.x for r in C.percent_to_fraction(once, "x").where("x is not null").collect()) == [-2.5, 0.05, 0.08]
    empty = spark.createDataFrame([(None,)], "x double")
    assert C.percent_to_fraction(empty, "x").count() == 1


def test_unions_do_not_split_groups(spark):
    from panelstone.session import stacked

    spark.conf.set("spark.sql.unionOutputPartitioning", "true")
    big = spark.range(20000).select((F.col("id") % 7).cast("string").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    small = spark.range(10).select((F.col("id") % 7).cast("string").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert stacked(big, small).groupBy("k").agg(F.sum("n").alias("n")).count() == 7


def test_the_last_of_a_load_wins_though_its_value_is_lower(spark, tmp_path):
    root = str(tmp_path)
    T.write(frame(spark, [("a", D, 1.0), ("z", D, 5.0)]), root, SPEC)
    load = spark.createDataFrame([("a", D, 9.0, 1), ("a", D, 2.0, 3), ("a", D, 7.0, 2), ("b", D, 4.0, 5), ("b", D, 6.0, None)], "k string, d date, v double, n int")
    T.upsert(load, root, SPEC, sequence=("n",))
    assert {r.k: r.v for r in T.read(spark, root, SPEC).collect()} == {"a": 2.0, "b": 4.0, "z": 5.0}
    T.upsert(frame(spark, [("a", D, 0.5)]), root, SPEC)  # a later load, a lower value
    assert {r.k: r.v for r in T.read(spark, root, SPEC).collect()} == {"a": 0.5, "b": 4.0, "z": 5.0}


def test_a_failed_write_leaves_the_table_and_its_readers_alone(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError):
        T.write(frame(spark, [("a", D, None)]), root, SPEC)
    assert T.read(spark, root, SPEC) is None
    T.write(frame(spark, [("a", D, 1.0)]), root, SPEC)
    before = T.read(spark, root, SPEC)
    dies = frame(spark, [("a", D, 3.0), ("b", D, 4.0)]).withColumn("v", F.when(F.col("k") == "b", F.raise_error("lost").cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        T.write(dies, root, SPEC)
    with pytest.raises(ValueError):
        T.write(frame(spark, [("a", D, 3.0), ("a", D, 4.0)]), root, SPEC)
    assert T.versions(spark, root, SPEC) == [1] and [r.v for r in T.read(spark, root, SPEC).collect()] == [1.0]
    assert not list((tmp_path / "raw" / ".staging").glob("t-*"))
    T.upsert(frame(spark, [("a", D, 2.0)]), root, SPEC)
    assert [r.v for r in before.collect()] == [1.0] and [r.v for r in T.read(spark, root, SPEC).collect()] == [2.0]
    T.write(frame(spark, [("c", D, 3.0)]), root, SPEC)
    assert T.versions(spark, root, SPEC) == [2, 3]
    T._folder(spark, f"{root}/raw/t/v00000004")[1].mkdirs(T._folder(spark, f"{root}/raw/t/v00000004")[0])
    with pytest.raises(Exception, match="v00000004"):  # another writer took the number in between
        T._move(spark, f"{root}/raw/t/v00000003", f"{root}/raw/t", "v00000004")


def test_copies_of_a_signal_are_settled_alike(spark):
    from panelstone.operators.ingest import dedupe_signals

    rows = [("u", 5.0, 1, {"s": "a"}), ("u", 3.0, 2, {"s": "c"}), ("u", 3.0, 2, {"s": "b"}), ("w", None, 1, None)]
    df = spark.createDataFrame(rows, "uid string, value double, n int, meta map<string,string>")
    for parts in (1, 4):
        got = {r.uid: (r.value, r.meta) for r in dedupe_signals(df.repartition(parts), ("n",)).collect()}
        assert got == {"u": (3.0, {"s": "c"}), "w": (None, None)}
