"""Every query of the engine against its SQL in DuckDB."""

import duckdb
import pytest

from lodestar.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    expected = db.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, expected))
    assert len(a) == len(b)
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize(("name", "key"), [("sort_asc", lambda r: r.o_totalprice), ("sort_desc", lambda r: -r.o_totalprice), ("sort_multi", lambda r: ([-ord(c) for c in r.o_orderpriority], r.o_totalprice)), ("freq_desc", lambda r: -r.freq)])
def test_order(spark, name, key):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert [key(r) for r in rows] == sorted(key(r) for r in rows)


def test_stale_summary_is_refused(spark):
    from lodestar.plans import star
    from lodestar.queries import LINEITEM_STAR, _summarised, star_query

    frames, summaries, versions = _summarised(spark, FOLDER)
    query = star_query(["lineitem", "orders"])
    for now in (None, versions | {"orders": "another"}):
        with pytest.raises(ValueError, match="version"):
            star.star_join(LINEITEM_STAR, query, frames, summaries=summaries, versions=now)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
