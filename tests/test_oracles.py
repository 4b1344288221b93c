"""Every query against its DuckDB counterpart on the small test tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from plaszcz.plans import catalog

DATA = Path(os.environ.get("ORACLE_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted([columns[i] for i in order]), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    answer = duck.execute(catalog.ORACLES[name])
    want = rows_of([c[0] for c in answer.description], answer.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
    assert want[1], "the query is to find something"
