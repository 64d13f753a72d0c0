"""Selections: tail per series (L1), latest row (L2), series of one city (L3), total order (L5),
filters (P14-P16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tail_n(df: DataFrame, n: int = 49, key: str = "city", time: str = "time") -> DataFrame:
    """L1: last ``n`` rows per series.

    ``row_number() <= n`` over a per-series window is planned with a partial ``WindowGroupLimit``
    before the shuffle, so at most ``n`` rows per series leave each map task."""
    w = Window.partitionBy(key).orderBy(F.col(time).desc())
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n).drop("_rk")


def tail_per_series(df: DataFrame, n_col: str, key: str = "city", time: str = "time") -> DataFrame:
    """Last ``n`` rows per series where ``n`` differs per series (column ``n_col``)."""
    w = Window.partitionBy(key).orderBy(F.col(time).desc())
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= F.col(n_col)).drop("_rk")


def latest_row(df: DataFrame, key: str = "city", time: str = "time") -> DataFrame:
    """L2: the row with the largest time per series (one row per series leaves each map task, as in ``tail_n``)."""
    return tail_n(df, 1, key, time)


def city_series(df: DataFrame, city: str, key: str = "city", time: str = "time") -> DataFrame:
    """L3: one series in time order (the filter on the key reaches the scan)."""
    return df.filter(F.col(key) == F.lit(city)).orderBy(time)


def total_order(df: DataFrame, key: str = "city", time: str = "time", global_sort: bool = False) -> DataFrame:
    """(city, time) order for a sink: range-partitioned global sort, or per-partition sort."""
    return df.orderBy(key, time) if global_sort else df.sortWithinPartitions(key, time)


def complete_rows(features: DataFrame) -> DataFrame:
    """Rows with a 24 h lag and a 72 h target."""
    return features.filter(F.col("aqi_lag_24h").isNotNull() & F.col("target_aqi_72h").isNotNull())


def label_rows(features: DataFrame, target: str) -> DataFrame:
    """Rows with a label for the horizon."""
    return features.filter(F.col(target).isNotNull())
