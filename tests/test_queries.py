"""Every registered query against the same rows from DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from scriptorium.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v.isoformat() if hasattr(v, "isoformat") else v


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    answer = duck.execute(ORACLES[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted_rows(frame.columns, frame.collect()) == sorted_rows(columns, answer.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_queries_that_find_nothing_in_the_tables_on_rows_that_occur(spark, tmp_path):
    """Key-value lines, contradictions, action items and near vectors: rows are there, and equal those of the SQL."""
    texts = ["Net Revenue: $1,200.50\nStatus: open\nYou must pay now. You should call. It will rain.", "Net Revenue: 900\nStatus: closed\nThey must pay now.", "Status: open\nNothing here", ""]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(i, [1.0, i / 300, 0.5], i % 2) for i in range(205)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("numeric_kv_stats", "contradictions", "action_items", "knn_min_sim"):
        frame, answer = QUERIES[name](spark, str(tmp_path)), con.execute(ORACLES[name])
        columns = [c[0] for c in answer.description]
        rows = frame.collect()
        assert rows, name
        assert sorted_rows(frame.columns, rows) == sorted_rows(columns, answer.fetchall()), name


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
