import math

import duckdb
import pytest

from metricspark import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


def plain(x):
    return None if isinstance(x, float) and math.isnan(x) else x


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_against_sql(spark, sf, con, name):
    df = catalogue.queries()[name](spark, sf)
    got = con.sql(catalogue.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(got.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    theirs = sorted((tuple(plain(r[got.columns.index(c)]) for c in cols) for r in got.fetchall()), key=key)
    assert theirs, "the query is vacuous"
    assert ours == theirs
