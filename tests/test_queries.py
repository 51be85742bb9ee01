"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tesserae.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(frame):
    def told(v):
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str([float(x) for x in v])
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(told(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql())))
def test_query_agrees_with_sql(spark, duck, small, name):
    got, want = registry.queries()[name](spark, small).toPandas(), duck.sql(registry.oracle_sql()[name].replace("/sf0.01/", "/sf0.001/")).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0


def test_entry():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(registry.oracle_sql()) <= set(entry.oracle_sql())
