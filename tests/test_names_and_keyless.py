"""Names by their rarest substring and as-of joins without a key, against plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from panelstone.operators.asof import asof_backward
from panelstone.operators.ingest import resolve_names


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_resolve_as_by_containment(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    registry = [(word(3), None if k % 9 == 0 else word(rng.randint(0, 9)), f"t{k:02d}") for k in range(40)]
    names = [word(rng.randint(0, 6)) for _ in range(120)] + [None, "", "A", "zz", "zzz"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
    out = resolve_names(df, spark.createDataFrame(registry, "company_name string, aliases string, ticker string"))
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r["resolved_ticker"] for r in out.collect()}

    def plain(n):
        if n is None:
            return None
        n = n.lower()
        exact = [t.upper() for c, _, t in registry if c == n]
        return min(exact or [t.upper() for _, a, t in registry if a is not None and n in a], default=None)

    assert got == {i: plain(n) for i, n in enumerate(names)}


def test_keyless_timeline_carries_over_empty_months(spark):
    rng = random.Random(6)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 900))
    series = [(day(), rng.choice([None, 1.0, 2.0, 3.0]), k) for k in range(25)]
    asked = [(k, day()) for k in range(200)] + [(200, None), (201, dt.date(2019, 1, 1)), (202, dt.date(2030, 1, 1))]
    left = spark.createDataFrame(asked, "id long, d date")
    right = spark.createDataFrame(series, "d date, v double, seq long")
    for strict in (False, True):
        out = asof_backward(left, right, [], "d", "d", {"v": "value"}, order_ties=["seq"], strict=strict)
        assert "windowspecdefinition(_at" not in plan_of(out)
        want = {}
        for k, d in asked:
            seen = [] if d is None else [(s, q, v) for s, v, q in series if s < d or (s == d and not strict)]
            want[k] = max(seen, key=lambda x: x[:2])[2] if seen else None
        assert {r["id"]: r["value"] for r in out.collect()} == want
    none = asof_backward(left, right.limit(0), [], "d", "d", {"v": "value"})
    assert none.where(F.col("value").isNotNull()).count() == 0 and none.count() == len(asked)
