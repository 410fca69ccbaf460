"""Every registered query of the graph engine runs on the smallest tables and gives what its SQL gives."""

import math
import os

import pytest

from graphloom.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def rows(columns, values):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, float):
            return str(round(v, 6))
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not isinstance(v, (int, str)) and getattr(v, "shape", ()):
            return str([str(x) for x in v])
        return str(v)

    return sorted(columns), sorted([plain(v[columns.index(c)]) for c in sorted(columns)] for v in values)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = df.collect()
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        columns = [d[0] for d in want.description]
        assert rows(df.columns, [tuple(r) for r in got]) == rows(columns, want.fetchall())
