import os

import __spark_entry__ as entry
import pytest

SMALL = "/root/testdata/sf0.001"


def test_every_query_is_callable_and_sql_has_a_query():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and all(callable(f) for f in names.values())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["src", "dst", "witness_count"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["greedy_landmarks", "mapper_edges", "components", "audit_summary", "h0_counts", "knn_capped_cover"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SMALL).toPandas()[list(want.columns)]
    order = list(want.columns)
    a, b = (d.sort_values(order).reset_index(drop=True).astype("float64") if d.dtypes.map(lambda t: t.kind in "biuf").all() else d.sort_values(order).reset_index(drop=True) for d in (got, want))
    assert len(a) == len(b) and ((a - b).abs().fillna(0) < 1e-6).all().all()
