"""Training-data queries equal their DuckDB SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

from quarry.llm.queries import ORACLES, QUERIES
from quarry.sources.tables import TABLE_NAMES

SF = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_oracle(spark, key):
    from check_oracle import canon
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[key](spark, SF)
    cur = con.execute(ORACLES[key])
    assert canon(df.columns, df.collect()) == canon([d[0] for d in cur.description], cur.fetchall())
