"""The rotation inside a group is one permutation, however the group is cut."""

import hashlib

from pyspark.sql import functions as F

from panelstone.operators.evaluate import rotate_within


def test_cutting_a_group_changes_nothing(spark):
    rows = [(g, f"e{k}", float(k)) for g, n in (("a", 60), ("b", 1), ("c", 7)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, entity string, y double")
    mark = F.md5(F.concat_ws("|", "g", "entity"))
    want = {}
    for g in "abc":
        order = sorted((hashlib.md5(f"{g}|{e}".encode()).hexdigest(), e, y) for h, e, y in rows if h == g)
        want |= {(g, e): order[i - 1][2] for i, (_, e, _) in enumerate(order)}
    for piece in (None, F.substring(mark, 1, 1), F.substring(mark, 1, 2)):
        out = rotate_within(df, ["g"], mark, "y", "other", piece)
        assert {(r["g"], r["entity"]): r["other"] for r in out.collect()} == want
