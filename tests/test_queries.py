"""Registered queries against their SQL on the small tables. Set ALL_QUERIES=1 to run every one."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
FOLDER = "/root/testdata/sf0.001"
SOME = ["grd1_date_grid", "wn13_beta", "jn7_interval_join", "jn8_attach_fundamentals", "pit8_ttm_series", "sp1_build_spans", "xs10_opportunity_scores", "fm4_valuation", "va7_dcf_project", "ev8_ic_by_group", "ev29_overfitting_probability", "snk2_upsert"]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the supplied tables are not here")


def names():
    import __spark_entry__ as entry

    return sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SOME


@pytest.mark.parametrize("name", names())
def test_query_matches_sql(spark, name):
    import duckdb
    from check_queries import TABLES, rows_of

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, rel.fetchall())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
