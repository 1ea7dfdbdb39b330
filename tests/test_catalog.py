"""Every query of the catalog against its SQL on DuckDB."""

import duckdb
import pytest

from runweave.plans import catalog


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(str, frame[columns].itertuples(index=False, name=None)))


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, small, name):
    assert rows(catalog.QUERIES[name](spark, small).toPandas()) == rows(con.execute(catalog.ORACLES[name]).df())
