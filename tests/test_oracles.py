"""Every bound query against its SQL in DuckDB, on the smallest tables; those without SQL must run."""

import datetime
import math

import pytest

from lodestar.bindings import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return str(v.replace(tzinfo=None)) if isinstance(v, datetime.datetime) else v


def shown(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(cols).collect()]
    if name in SQL:
        cur = duck.execute(SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == cols
        assert shown(got) == shown(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())
