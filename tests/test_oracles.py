"""Every query with an oracle equals its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver

DATA = "/root/testdata/sf0.001"

ORACLES = driver.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def rows_of(rows, columns):
    flat = lambda v: round(v, 6) if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([flat(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = driver.queries()[name](spark, DATA)
    said = duck.execute(ORACLES[name])
    columns = [d[0] for d in said.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.collect(), df.columns) == rows_of(said.fetchall(), columns)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() == 5
