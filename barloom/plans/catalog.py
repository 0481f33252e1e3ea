"""Every market query with its DuckDB twin.

Doubles are rounded on both sides: sums are the same numbers in another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

BARS_SQL = """bars0 AS (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS dt, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2),
bars AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1 AS INTEGER) AS i,
         ln(close) AS x, ln(open) AS lo, ln(high) AS lh, ln(low) AS ll
  FROM bars0 WHERE close > 0)"""


def add(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """``df`` with its doubles rounded."""
    return df.select([F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


from . import indicator_queries, grid_queries, resample_queries, stats_queries, tool_queries  # noqa: E402

for _part in (indicator_queries, stats_queries, grid_queries, resample_queries, tool_queries):
    _part.register(add)
