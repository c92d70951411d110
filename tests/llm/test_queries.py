"""The registered queries of the training-data operators on the small tables: against their SQL where they have one, else their rows."""

import os

import pytest

from larder.llm.queries import ORACLES, QUERIES

SF = os.environ.get("LARDER_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: The table whose rows a query returns, one for one.
ROWS = {"op1": "pages", "op2": "documents", "op3": "documents", "op5": "documents", "op6": "pages", "op7": "documents", "op8": "documents", "op9": "documents"}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    import duckdb

    got = QUERIES[name](spark, SF)
    rows = sorted(repr([r[c] for c in sorted(got.columns)]) for r in got.collect())
    if (table := ROWS.get(name.split("_")[0])) is not None:
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert rows
    if name in ORACLES:
        c = duckdb.connect()
        for t in ("pages", "conversations"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = c.sql(ORACLES[name])
        at = [want.columns.index(x) for x in sorted(want.columns)]
        assert sorted(want.columns) == sorted(got.columns)
        assert rows == sorted(repr([r[i] for i in at]) for r in want.fetchall())
