"""Catalog of bound queries: Spark builder + DuckDB oracle per build key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.tables import Tables, with_bindings

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def _half_up_rounding(sql: str) -> str:
    """Make DuckDB's ``round(x, d)`` round like Spark's.

    Spark rounds the shortest decimal text of a double half-up; DuckDB
    scales the binary value, so exact halves (e.g. 33.2609375 to 6 places)
    can go the other way.  Each ``round(x, d)`` in an oracle is rewritten
    to round the decimal text of ``x`` instead.
    """
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 0, j + 6, None
        while k < len(sql):
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                comma = k
            k += 1
        inner = sql[j + 6:k]
        if comma is None:
            arg, places = inner, "0"
        else:
            arg, places = sql[j + 6:comma], sql[comma + 1:k].strip()
        arg = _half_up_rounding(arg)
        out.append(sql[i:j])
        out.append(f"CAST(round(CAST(CAST(({arg}) AS VARCHAR) AS DECIMAL(38,12)), {places}) AS DOUBLE)")
        i = k + 1


def register(key: str, oracle: str | None = None, bind: tuple[str, ...] = ()):
    """Register ``fn(t: Tables) -> DataFrame`` under ``key``.

    ``oracle`` is DuckDB SQL over the driver tables; ``bind`` names the
    analytics views (users, sessions, products, event_facts) it uses, which
    are prepended as CTEs.
    """

    def deco(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate key {key}")

        def builder(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        builder.__name__ = fn.__name__
        builder.__doc__ = fn.__doc__
        QUERIES[key] = builder
        if oracle is not None:
            sql = with_bindings(oracle, *bind) if bind else oracle.strip()
            ORACLES[key] = _half_up_rounding(sql)
        return fn

    return deco
