"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from lodestar.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    expected = db.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, FOLDER).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    order = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    assert order(got).equals(order(expected))
