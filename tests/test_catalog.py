"""Every query of the catalogue against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from corpusloom.plans import catalog, entries  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v:.5f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    got = sorted(tuple(cell(r[k]) for k in sorted(df.columns)) for r in df.collect())
    if name not in catalog.SQL:
        assert got
        return
    found = duck.execute(catalog.SQL[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(k) for k in sorted(columns)]
    assert got == sorted(tuple(cell(r[i]) for i in order) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
