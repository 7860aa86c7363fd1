"""Every query with a SQL twin against DuckDB, on the small tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from arealith.plans import catalogue

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "None"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v) + 0.0:.9g}" if isinstance(v, (int, float)) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        p = Path(SF, t)
        c.execute(f"create view {p.stem} as select * from '{p}/*.parquet'" if p.is_dir() else f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    rows, cols = df.collect(), sorted(df.columns)
    r = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert sorted(tuple(norm(x[c]) for c in cols) for x in rows) == sorted(tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall())
