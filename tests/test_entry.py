import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
# one query per family on the smallest tables, against its SQL
CHECKED = ["postings", "search_exact_batch", "name_score", "filter_files", "reconcile_diff", "delta_merge", "rbo_eval", "p3_found", "p4_found", "p6_found"]


def test_names_are_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p3_found", "p4_found", "p6_found"} <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    want = con.execute(entry.oracle_sql()[name]).fetch_df()
    got = entry.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(repr([round(x, 6) if isinstance(x, float) else str(x) for x in r]) for r in d[cols].itertuples(index=False))
    assert rows(got) == rows(want)
