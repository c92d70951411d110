"""Every registered query against its SQL, on a small set of tables."""

import decimal
import os

import pytest

from larder.plans.queries import ORACLES, QUERIES

SF = os.environ.get("LARDER_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def shown(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    return round(x, 6) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr([shown(r[c]) for c in columns]) for r in got.collect())
    if name not in ORACLES:
        assert rows
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr([shown(r[i]) for i in at]) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
