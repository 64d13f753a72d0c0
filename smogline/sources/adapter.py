"""Adapter views that map the driver tables onto the readings schema.

``readings_events``: one series per ``event_type``, one row per hour with an event (main fixture).
``readings_lineitem``: one series per supplier, one row per ship date (many series; bench fixture).

Both are plain aggregations; Spark runs them with partial (map-side) aggregation, so a hot series
or hour never sits in one task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aqi import aqi, aqi_sql
from ..functions.calendar import hour_floor
from ..schemas import READINGS_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings without ``aqi`` (19 - 1 columns) from ``events``."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    ev = ev.select(
        F.col("event_type").alias("city"),
        hour_floor(F.col("ts").cast("timestamp_ntz")).alias("time"),
        "event_id", "user_id", "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )
    g = ev.groupBy("city", "time").agg(
        F.min_by("k", "event_id").alias("_k1"),
        F.min_by("value", "event_id").alias("_v1"),
        F.min("value").alias("_vmin"),
        F.max("value").alias("_vmax"),
        F.min("k").alias("_kmin"),
        F.max("k").alias("_kmax"),
        F.count(F.lit(1)).alias("_n"),
        F.max("user_id").alias("_umax"),
    )
    k1, v1 = F.col("_k1"), F.col("_v1")
    return g.select(
        "time", "city",
        F.col("_vmin").alias("temperature_2m"),
        F.col("_kmax").alias("relative_humidity_2m"),
        (F.lit(1000.0) + F.col("_kmin")).alias("surface_pressure"),
        F.col("_n").cast("double").alias("wind_speed_10m"),
        (F.col("_umax") % F.lit(360)).cast("double").alias("wind_direction_10m"),
        F.col("_kmin").alias("cloud_cover"),
        F.when(k1 == 42, F.lit(None).cast("double")).otherwise(k1).alias("precipitation"),
        F.col("_vmax").alias("shortwave_radiation"),
        F.when(k1 == 13, F.lit(None).cast("double")).otherwise(v1).alias("pm2_5"),
        F.when(k1.isin(13, 77), F.lit(None).cast("double")).otherwise(k1 * F.lit(6.5)).alias("pm10"),
        (v1 + F.lit(1.0)).alias("nitrogen_dioxide"),
        (v1 + F.lit(2.0)).alias("sulphur_dioxide"),
        (v1 + F.lit(3.0)).alias("carbon_monoxide"),
        (v1 + F.lit(4.0)).alias("ozone"),
        F.lit(None).cast("double").alias("dust"),
        F.lit(None).cast("double").alias("aerosol_optical_depth"),
    )


def readings_events(spark: SparkSession, sf_dir: str, missing: str = "skip") -> DataFrame:
    return raw_events(spark, sf_dir).withColumn("aqi", aqi(missing=missing)).select(*READINGS_COLUMNS)


def longest_lineitem_series(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the largest supplier, an upper bound of its readings (one small aggregate)."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]


def raw_lineitem(spark: SparkSession, sf_dir: str, by_series: bool = False) -> DataFrame:
    """``by_series`` partitions the rows by supplier before they are grouped: the grouping and later windows per series
    then need no further shuffle (for short series, ``longest_lineitem_series``: a supplier's rows meet in one task)."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("city"), F.col("l_shipdate").cast("timestamp_ntz").alias("time"),
        "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_linenumber", "l_orderkey")
    g = (li.repartition("city") if by_series else li).groupBy("city", "time").agg(
        F.max("l_quantity").alias("_qmax"), F.min("l_quantity").alias("_qmin"),
        F.max("l_discount").alias("_dmax"), F.max("l_tax").alias("_tmax"),
        F.max("l_extendedprice").alias("_pmax"), F.count(F.lit(1)).alias("_n"),
        F.max("l_linenumber").alias("_lmax"), F.max("l_orderkey").alias("_omax"))
    q = F.col("_qmax")
    return g.select(
        "time", "city",
        F.col("_qmin").alias("temperature_2m"),
        (F.col("_tmax") * F.lit(1000.0)).alias("relative_humidity_2m"),
        (F.lit(1000.0) + F.col("_qmin")).alias("surface_pressure"),
        F.col("_n").cast("double").alias("wind_speed_10m"),
        (F.col("_omax") % F.lit(360)).cast("double").alias("wind_direction_10m"),
        F.col("_lmax").cast("double").alias("cloud_cover"),
        (F.col("_dmax") * F.lit(10.0)).alias("precipitation"),
        (F.col("_pmax") / F.lit(100.0)).alias("shortwave_radiation"),
        (q * F.lit(10.0)).alias("pm2_5"),
        (F.col("_dmax") * F.lit(5000.0)).alias("pm10"),
        (q + F.lit(1.0)).alias("nitrogen_dioxide"),
        (q + F.lit(2.0)).alias("sulphur_dioxide"),
        (q + F.lit(3.0)).alias("carbon_monoxide"),
        (q + F.lit(4.0)).alias("ozone"),
        F.lit(None).cast("double").alias("dust"),
        F.lit(None).cast("double").alias("aerosol_optical_depth"),
    )


def readings_lineitem(spark: SparkSession, sf_dir: str, missing: str = "skip", by_series: bool = False) -> DataFrame:
    return raw_lineitem(spark, sf_dir, by_series).withColumn("aqi", aqi(missing=missing)).select(*READINGS_COLUMNS)


# --- the same views as DuckDB SQL (oracle side) ---------------------------------------------------

RAW_EVENTS_SQL = """
SELECT time, city,
  vmin AS temperature_2m, kmax AS relative_humidity_2m, 1000e0 + kmin AS surface_pressure,
  CAST(n AS DOUBLE) AS wind_speed_10m, CAST(umax % 360 AS DOUBLE) AS wind_direction_10m,
  kmin AS cloud_cover, CASE WHEN k1 = 42 THEN NULL ELSE k1 END AS precipitation,
  vmax AS shortwave_radiation,
  CASE WHEN k1 = 13 THEN NULL ELSE v1 END AS pm2_5,
  CASE WHEN k1 IN (13, 77) THEN NULL ELSE k1 * 6.5e0 END AS pm10,
  v1 + 1e0 AS nitrogen_dioxide, v1 + 2e0 AS sulphur_dioxide, v1 + 3e0 AS carbon_monoxide, v1 + 4e0 AS ozone,
  CAST(NULL AS DOUBLE) AS dust, CAST(NULL AS DOUBLE) AS aerosol_optical_depth
FROM (
  SELECT event_type AS city, date_trunc('hour', ts) AS time,
    arg_min(k, event_id) AS k1, arg_min(value, event_id) AS v1, min(value) AS vmin, max(value) AS vmax,
    min(k) AS kmin, max(k) AS kmax, count(*) AS n, max(user_id) AS umax
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) e
  GROUP BY 1, 2
) g
"""

_READ_COLS = ", ".join(READINGS_COLUMNS[:-1])


def readings_events_sql(missing: str = "skip") -> str:
    return f"SELECT {_READ_COLS}, {aqi_sql(missing=missing)} AS aqi FROM ({RAW_EVENTS_SQL}) r"


def readings_hot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lineitem readings folded into one series (a key holding every row): time = ship date plus
    the supplier number in seconds, unique per (supplier, day) below 86,400 suppliers (sf 8)."""
    r = readings_lineitem(spark, sf_dir)
    t = (F.col("time") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("city").cast("int"))).cast("timestamp_ntz")
    return r.withColumn("time", t).withColumn("city", F.lit("all"))


RAW_LINEITEM_SQL = """
SELECT time, city,
  qmin AS temperature_2m, tmax * 1000e0 AS relative_humidity_2m, 1000e0 + qmin AS surface_pressure,
  CAST(n AS DOUBLE) AS wind_speed_10m, CAST(omax % 360 AS DOUBLE) AS wind_direction_10m,
  CAST(lmax AS DOUBLE) AS cloud_cover, dmax * 10e0 AS precipitation, pmax / 100e0 AS shortwave_radiation,
  qmax * 10e0 AS pm2_5, dmax * 5000e0 AS pm10,
  qmax + 1e0 AS nitrogen_dioxide, qmax + 2e0 AS sulphur_dioxide, qmax + 3e0 AS carbon_monoxide, qmax + 4e0 AS ozone,
  CAST(NULL AS DOUBLE) AS dust, CAST(NULL AS DOUBLE) AS aerosol_optical_depth
FROM (
  SELECT CAST(l_suppkey AS VARCHAR) AS city, l_shipdate AS time, max(l_quantity) AS qmax, min(l_quantity) AS qmin,
    max(l_discount) AS dmax, max(l_tax) AS tmax, max(l_extendedprice) AS pmax, count(*) AS n,
    max(l_linenumber) AS lmax, max(l_orderkey) AS omax
  FROM lineitem GROUP BY 1, 2
) g
"""


def readings_lineitem_sql(missing: str = "skip") -> str:
    return f"SELECT {_READ_COLS}, {aqi_sql(missing=missing)} AS aqi FROM ({RAW_LINEITEM_SQL}) r"


def readings_hot_series_sql() -> str:
    cols = ", ".join(c for c in READINGS_COLUMNS if c not in ("time", "city"))
    return (f"SELECT time + to_seconds(CAST(city AS INTEGER)) AS time, 'all' AS city, {cols} "
            f"FROM ({readings_lineitem_sql()}) l")
