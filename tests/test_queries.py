"""Every dictionary-coding query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from slotgram.plans import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SLOW = {"byte_offsets", "match_longest_per_pos"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(registry.ORACLE_SQL) - SLOW))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, DIR)
    want = con.execute("SELECT " + ", ".join(f'"{c}"' for c in df.columns) + f" FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
