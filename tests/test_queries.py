"""Every query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from tilework.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(found):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in found)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({registry.ORACLES[name]})").fetchall()
    assert rows(map(tuple, df.select(*columns).collect())) == rows(expected)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["field_agreement", "overlap_ncc", "components"])
def test_tiles_without_contrast(spark, duck, name, tmp_path):
    """Constant tiles have no correlation; the queries say so as their SQL does."""
    flat = spark.range(150).selectExpr("id AS vec_id", "transform(sequence(1, 64), p -> cast(if(id % 25 < 3, (p * 7 + id * 5) % 11 / 40 - 0.1, 0.1) as float)) AS embedding")
    flat.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    df = registry.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        expected = con.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({registry.ORACLES[name]})").fetchall()
    assert rows(map(tuple, df.select(*columns).collect())) == rows(expected) and expected


def test_votes_meet_by_equal_shifts(spark):
    """No join of shift_consensus compares all candidates with all others."""
    plan = registry.QUERIES["shift_consensus"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
