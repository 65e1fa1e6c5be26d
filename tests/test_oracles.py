"""Every query with an oracle gives the oracle's rows."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k in entry.queries()}


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got_columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in got_columns) for r in df.collect()), key=repr)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == got_columns
    at = [names.index(c) for c in got_columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want
