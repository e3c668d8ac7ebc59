"""Every query that has SQL gives the rows that DuckDB gives, at the smallest scale."""

import os

import duckdb
import pytest

from merchantry.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def shown(rows, columns):
    return sorted(repr([float(f"{r[c]:.9g}") if isinstance(r[c], float) else r[c] for c in sorted(columns)]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(name, spark, duck, sf):
    found = catalog.queries()[name](spark, sf)
    result = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(columns)
    expected = [dict(zip(columns, r, strict=True)) for r in result.fetchall()]
    assert shown([r.asDict() for r in found.collect()], columns) == shown(expected, columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(name, spark, sf):
    """The rows of these are compared with plain Python in test_operators.py; here each has rows and distinct ones."""
    rows = catalog.queries()[name](spark, sf)
    assert rows.count() == rows.distinct().count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
