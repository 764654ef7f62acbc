import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def same(spark, con, name, query, sql):
    got = query(spark, SF)
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)

    def rows(found, names):
        at = [names.index(c) for c in columns]
        return sorted((tuple(r[i] for i in at) for r in found), key=str)

    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_queries_agree_with_their_sql(spark):
    import duckdb

    from bytelode.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    assert set(ORACLES) <= set(QUERIES)
    for name, sql in ORACLES.items():
        same(spark, con, name, QUERIES[name], sql)


@pytest.mark.parametrize("gone", ["bytelode.llm", "bytelode.llm.queries"])
def test_the_rest_stands_without_the_corpus_operators(gone):
    """Also where an empty folder of the subpackage is left."""
    script = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", {gone!r}):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "contamination_pairs" in e.queries() and not any(n.startswith("op") for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", script], cwd=ROOT, check=True)


def test_words_at_the_end_of_a_text_count_once(spark, tmp_path):
    import duckdb

    from bytelode.queries import ORACLES, QUERIES

    spark.createDataFrame([(1, "station threen"), (2, "threen onionings"), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "threen, onionings")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = [(1, "threen", 1), (2, "onionings", 1), (2, "threen", 1)]
    assert sorted((r.doc_id, r.word, r.n_matches) for r in QUERIES["count_index_table_documents"](spark, str(tmp_path)).collect()) == want
    assert sorted(con.sql(f"select doc_id, word, n_matches from ({ORACLES['count_index_table_documents']})").fetchall()) == want


def test_workers_are_sent_small_batches(spark):
    from bytelode.session import ship

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        ship(spark)
        assert spark.conf.get(key) == f"{4 << 20}b"
        import pyarrow as pa

        most = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
        texts = spark.range(4000, numPartitions=1).selectExpr("repeat('x', 5000) AS text")
        assert max(r.n for r in texts.mapInArrow(most, "n long").collect()) < 5 << 20
        spark.conf.set(key, "1000000b")
        ship(spark)
        assert spark.conf.get(key) == "1000000b"  # a session's own setting stays
    finally:
        spark.conf.set(key, before)
