"""Every plan against its SQL on the smallest tables."""

import duckdb
import pytest

from leafgraph import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(repr([clean(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_plan_matches_sql(spark, duck, name):
    got = plans.queries()[name](spark, DIR)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_every_plan_without_sql_runs(spark):
    for name, query in plans.queries().items():
        if name not in SQL:
            assert query(spark, DIR).count() > 0, name
