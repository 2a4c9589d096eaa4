"""Every query of the library against its SQL on DuckDB, over the smallest tables."""

import datetime as dt
import math
import os
from decimal import Decimal

import pytest

duckdb = pytest.importorskip("duckdb")

from riskloom.plans.queries import ORACLES, QUERIES  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        return round(float(value), 9)
    return value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else value


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted([tuple(plain(v[k]) for k in order) for v in values], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, oracle, name):
    df = QUERIES[name](spark, SF_DIR)
    found = oracle.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, found.fetchall())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
