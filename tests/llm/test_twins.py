"""Queries of the subpackage against their SQL twins."""

import os

import duckdb
import pytest

from tests.test_queries import DATA, TABLES, rows
from tilework.llm import registry


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = con.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({registry.ORACLES[name]})").fetchall()
    assert rows(map(tuple, df.select(*columns).collect())) == rows(expected)
