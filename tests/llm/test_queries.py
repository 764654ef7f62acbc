import os

import pytest

import __spark_entry__
from bytelode.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries()) and set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    columns = sorted(want.columns)
    rows = lambda found, names: sorted((tuple(r[names.index(c)] for c in columns) for r in found), key=str)
    assert sorted(got.columns) == columns
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)
