"""Every registered query against its check SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lexline.checks import registry

DATA = Path("/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
TYPES = {"double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def comparable(rows):
    return sorted(tuple((v is not None, str(v)) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    rows = result.fetchall()
    types = dict(r[:2] for r in duck.execute(f"DESCRIBE {ORACLES[name]}").fetchall())
    assert sorted(names) == columns
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types
    order = [names.index(c) for c in columns]
    got = comparable(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == comparable(tuple(r[i] for i in order) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "doc_id"


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0
