"""Every query of the reference's operators against its DuckDB twin."""

import math
from collections import Counter

import duckdb
import pytest

from scanweft.plans.driver import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in ("part", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(rows):
    return Counter(tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    out = QUERIES[name](spark, DIR)
    columns = sorted(out.columns)
    got = plain(out.select(columns).collect())
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    want = plain(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert got == want
    assert got or name == "catalog_problems"
