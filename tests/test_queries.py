"""The driver's queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from skein.plans import driver, oracle

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(driver.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, duck, name):
    got = driver.queries()[name](spark, DIR)
    cols = sorted(got.columns)
    want = duck.execute("select {} from ({})".format(", ".join(f'"{c}"' for c in cols), oracle.oracle_sql()[name])).fetchall()
    rows = sorted(map(tuple, got.select(*cols).collect()), key=repr)
    assert rows == sorted(want, key=repr) and rows
