"""Registered queries: ``name -> (spark callable(spark, sf_dir) -> DataFrame, DuckDB SQL or None)``.

Every query reads the driver tables (through the adapter views) in full. Non-exact doubles (standard
deviations, exponential means, trigonometry, metric sums) are rounded to 6 digits and ``+ 0.0`` on both
sides so that value hashes are stable; everything else is compared as computed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def stable(df: DataFrame, cols) -> DataFrame:
    """round(x, 6) + 0.0 on the given double columns (removes -0.0 and last-bit noise)."""
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in cols})


def stable_sql(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


def load_all() -> None:
    """Imports the modules that register queries."""
    from . import queries_change, queries_core, queries_linear, queries_more  # noqa: F401
