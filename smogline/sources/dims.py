"""Dimension tables: cities (S1) and breakpoints (S2). Both have a fixed, tiny size, which is what
makes broadcasting them safe: they do not grow with the readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.aqi import PM10_BREAKPOINTS, PM25_BREAKPOINTS

# The shipped city dimension (name, latitude, longitude, province).
CITIES = [
    ("Karachi", 24.8607, 67.0011, "Sindh"),
    ("Lahore", 31.5497, 74.3436, "Punjab"),
    ("Islamabad", 33.6844, 73.0479, "ICT"),
    ("Rawalpindi", 33.5651, 73.0169, "Punjab"),
    ("Faisalabad", 31.4504, 73.1350, "Punjab"),
    ("Multan", 30.1575, 71.5249, "Punjab"),
    ("Quetta", 30.1798, 66.9750, "Balochistan"),
    ("Hyderabad", 25.3960, 68.3578, "Sindh"),
    ("Sialkot", 32.4945, 74.5229, "Punjab"),
]

CITY_SCHEMA = T.StructType([
    T.StructField("city", T.StringType(), False), T.StructField("lat", T.DoubleType(), False),
    T.StructField("lon", T.DoubleType(), False), T.StructField("province", T.StringType(), False),
])
BREAKPOINT_SCHEMA = T.StructType([
    T.StructField("pollutant", T.StringType(), False), T.StructField("bp_lo", T.DoubleType(), False),
    T.StructField("bp_hi", T.DoubleType(), False), T.StructField("aqi_lo", T.IntegerType(), False),
    T.StructField("aqi_hi", T.IntegerType(), False),
])


def cities(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows if rows is not None else CITIES, CITY_SCHEMA)


def breakpoints(spark: SparkSession) -> DataFrame:
    rows = [("pm25", float(lo), float(hi), alo, ahi) for lo, hi, alo, ahi in PM25_BREAKPOINTS]
    rows += [("pm10", float(lo), float(hi), alo, ahi) for lo, hi, alo, ahi in PM10_BREAKPOINTS]
    return spark.createDataFrame(rows, BREAKPOINT_SCHEMA)


def series_dimension(readings: DataFrame) -> DataFrame:
    """Dimension derived from the data: one row per series key with its first and last reading.

    Used where the fixed city list does not describe the input (adapter series, sensors)."""
    from pyspark.sql import functions as F
    return readings.groupBy("city").agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"),
                                        F.count(F.lit(1)).alias("n_rows"))
