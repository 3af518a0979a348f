"""Each training-data query, through its registered callable, against its SQL on the smallest tables."""

import duckdb
import pytest

from slotgram.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, DIR)
    want = con.execute("SELECT " + ", ".join(f'"{c}"' for c in df.columns) + f" FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)) and want
