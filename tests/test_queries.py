"""Every corpus query against its SQL on the small tables."""

import math

import duckdb
import pytest

from glossa.plans import corpus
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(corpus.queries()))
def test_query(spark, con, name):
    f, sql = corpus.QUERIES[name]
    df = f(spark, SF)
    rows = sorted(str(tuple(plain(x) for x in r)) for r in df.collect())
    if sql is None:
        assert rows
        return
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    assert rows == sorted(str(tuple(plain(r[k]) for k in at)) for r in got.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
