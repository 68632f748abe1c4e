import duckdb
import pytest

from tidefold.llm.oracles import ORACLES
from tidefold.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want, got = connection.sql(ORACLES[name]).df(), QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda df: sorted(
        map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None))
    )
    assert rows(got) == rows(want)
