"""Every reference query against its SQL in DuckDB."""

import os

import pytest

from strandloom import reference_queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not there")


@pytest.mark.parametrize("name", sorted(reference_queries.queries()))
def test_query_equals_sql(spark, name):
    import duckdb

    frame = reference_queries.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    found = sorted(tuple(map(str, r)) for r in frame.select(*columns).collect())
    with duckdb.connect() as db:
        for table in ("documents", "benchmark"):
            db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
        answer = db.sql(reference_queries.oracle_sql()[name])
        order = [answer.columns.index(c) for c in columns]
        assert sorted(answer.columns) == columns
        assert found == sorted(tuple(str(r[i]) for i in order) for r in answer.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_operators(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("strandloom.llm")] + ["strandloom.llm", "strandloom.llm.queries", "corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.delattr("strandloom.llm", raising=False)
    try:
        alone = importlib.reload(entry)
        assert set(alone.queries()) == set(alone.oracle_sql()) == set(reference_queries.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
