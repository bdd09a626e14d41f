"""Every registered query of the library against its DuckDB SQL."""

import math

import duckdb
import pytest

from circuitlens.plans import catalog
from circuitlens.plans.views import TABLES

FOLDER = "/root/testdata/sf0.001"


def key(row):
    """Order of rows that last digits of floats don't change, as far as anything else tells rows apart."""
    return [str(round(v, 3) + 0.0) if isinstance(v, float) else str(v) for v in row]


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return str(a) == str(b)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    found = catalog.queries()[name](spark, FOLDER)
    if name not in catalog.oracle_sql():
        assert found.count() > 0
        return
    want = db.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    rows, wanted = sorted(map(tuple, found.select(*columns).collect()), key=key), sorted(want.fetchall(), key=key)
    assert len(rows) == len(wanted)
    assert [pair for pair in zip(rows, wanted) if not all(map(same, *pair))] == []


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(catalog.queries()) <= set(entry.queries())
