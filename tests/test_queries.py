import glob
import math
import os

import duckdb
import pytest

from plumbline import plans

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    found = plans.queries()[name](spark, SF)
    rows = found.collect()
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert found.columns
        return
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    order = sorted(columns)
    assert sorted(found.columns) == order
    expected = sorted((tuple(norm(dict(zip(columns, r))[c]) for c in order) for r in cursor.fetchall()), key=key)
    assert sorted((tuple(norm(r[c]) for c in order) for r in rows), key=key) == expected
