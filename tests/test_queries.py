"""The catalogue against DuckDB on the smallest tables."""

import duckdb
import pytest

from corvane.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events"):
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    out = duck.execute(SQL[name])
    at = [[x[0] for x in out.description].index(c) for c in cols]
    assert got == sorted(tuple(str(r[i]) for i in at) for r in out.fetchall())
