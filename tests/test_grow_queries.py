"""Queries of growqueries give the rows of their SQL."""

import duckdb
import pytest

from quillgrid.plans import growqueries
from quillgrid.plans.queries import ORACLES, QUERIES
from tests.conftest import DATA

NAMES = sorted(n for n, f in QUERIES.items() if f.__module__ == growqueries.__name__)


@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for p in (DATA / "sf0.001").glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = QUERIES[name](spark, str(DATA / "sf0.001")), con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    assert rows and rows == sorted(map(repr, want.select(",".join(f'"{c}"' for c in columns)).fetchall()))
