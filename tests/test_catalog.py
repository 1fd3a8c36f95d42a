"""Every registered query runs on sf0.001 and equals its DuckDB oracle."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from conftest import SF_SMALL  # noqa: E402

from quarry.plans.catalog import ORACLES, QUERIES  # noqa: E402

KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def duck():
    import duckdb
    from quarry.sources.tables import TABLE_NAMES
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


SURVEY_KEYS = ([f"IO{i}" for i in range(1, 12)] + [f"F{i}" for i in range(1, 15)] + [f"J{i}" for i in range(1, 15)]
               + [f"A{i}" for i in range(1, 19)] + [f"W{i}" for i in range(1, 19)] + [f"O{i}" for i in range(1, 4)]
               + [f"U{i}" for i in range(1, 5)] + [f"X{i}" for i in range(1, 12)]
               + [f"E{i}" for i in list(range(1, 13)) + [14, 15, 16]] + [f"L{i}" for i in range(1, 17)]
               + ["P1", "P2"] + [f"M{i}" for i in range(1, 10)] + [f"T{i}s" for i in range(1, 11)]
               + [f"R{i}" for i in range(1, 15)])


def test_registry_complete():
    have = {k.split("_")[0] for k in KEYS}
    assert len(SURVEY_KEYS) == 159
    assert set(SURVEY_KEYS) <= have
    assert set(ORACLES) <= set(KEYS)
    assert set(KEYS) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["d_year", "c_nation", "profit"]


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, duck, key):
    from check_oracle import canon
    df = E.queries()[key](spark, SF_SMALL)
    rows = df.collect()
    if key not in ORACLES:
        return
    cur = duck.execute(ORACLES[key])
    c1, r1 = canon(df.columns, rows)
    c2, r2 = canon([d[0] for d in cur.description], cur.fetchall())
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_approx_distinct_within_bound(spark):
    rows = E.queries()["A5_approx_distinct"](spark, SF_SMALL).collect()
    assert rows
    for r in rows:
        assert abs(r["approx_users"] - r["exact_users"]) <= max(2, 0.05 * r["exact_users"])
