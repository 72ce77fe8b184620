"""The stages that keep or mask rows, on tables whose columns clash with their own names, on repeats, nulls and no rows at all."""

import pytest
from pyspark.sql import functions as F

from panelstone.llm.decontamination import drop_contaminated
from panelstone.llm.minhash import drop_near_duplicates
from panelstone.llm.pii import mask_pii
from panelstone.llm.toxicity import DEFAULT, Model, drop_toxic

PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = [(1, PASSAGE), (2, PASSAGE), (3, "write to jo@mail.com for the list of other things today"), (3, "write to jo@mail.com for the list of other things today"), (4, None), (5, "")]
MODEL = Model((), tuple(float(x) for x in DEFAULT))


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    cell = F.struct(F.lit(1).alias("odd name"), F.lit("x").alias("b"))
    return df.select("*", F.lit(7).alias("_gone"), F.lit(8).alias("_TWICE"), cell.alias("cell"), F.lit(9).alias("odd name"))


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_near_duplicates_keep_clashing_columns(odd):
    out = drop_near_duplicates(odd)
    assert out.columns == odd.columns
    assert ids(out) == [1, 3, 4, 5]  # of the copies 1 and 2 the smaller id stays, of the repeated row one


def test_contaminated_rows_go_with_clashing_columns(spark, odd):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    out = drop_contaminated(odd, items)
    assert out.columns == odd.columns and ids(out) == [3, 3, 4, 5]
    assert ids(drop_contaminated(odd, items.limit(0))) == [1, 2, 3, 3, 4, 5]


def test_masking_and_toxicity_carry_any_struct(odd):
    masked = mask_pii(odd)
    assert masked.schema == odd.schema
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert texts[3] == "write to [email] for the list of other things today" and texts[4] is None and texts[5] == ""
    kept = drop_toxic(odd, MODEL)
    assert kept.schema == odd.schema and ids(kept) == [1, 2, 3, 3, 4, 5]
    assert {(r["cell"]["odd name"], r["odd name"]) for r in kept.collect()} == {(1, 9)}


def test_empty_tables_stay_empty(spark, odd):
    none = odd.limit(0)
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    for out in (drop_near_duplicates(none), drop_contaminated(none, items), mask_pii(none), drop_toxic(none, MODEL)):
        assert out.columns == odd.columns and out.count() == 0
