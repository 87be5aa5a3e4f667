"""Every registered query of the engine gives the rows of its SQL on the small tables."""

import os

import pytest

from folioscope import catalog
from folioscope.cluster import ship

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the small tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{name}')")
    return con


def cells(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(str(x) for x in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck):
    ship(spark)
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    if name in catalog.ORACLES:
        assert cells(got) == cells(duck.execute(catalog.ORACLES[name]).fetchdf())
    else:
        assert len(got)
