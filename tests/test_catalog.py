"""Every query with SQL gives the SQL's rows."""

from collections import Counter
from pathlib import Path

import pytest

from graftline.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    done = duck.execute(ORACLE_SQL[name])
    columns = [x[0] for x in done.description]
    want = [dict(zip(columns, r, strict=True)) for r in done.fetchall()]
    names = sorted(got.columns)
    assert names == sorted(columns)
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(tuple(r[c] for c in names) for r in want)
