"""Every registered query against its DuckDB SQL."""

import glob
import os

import duckdb
import pytest
from helpers import sf

import __spark_entry__ as entry

from tidefold.verify.registry import QUERIES as OWN

SF = sf("0.001")
# The library's own; queries that are added to them are tested where they come from.
QUERIES = {name: query for name, query in entry.queries().items() if name in OWN}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in OWN}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(file).removesuffix(".parquet")
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


def test_each_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == names
    at = [relation.columns.index(column) for column in names]
    expected = [tuple(row[i] for i in at) for row in relation.fetchall()]
    assert expected
    assert ordered(tuple(row) for row in df.select(*names).collect()) == ordered(expected)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {"copied", "duplicate (hash exists)"} <= {row["state"] for row in rows}
