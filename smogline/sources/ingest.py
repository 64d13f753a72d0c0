"""Landed sources (S3-S11) and sinks.

The reference calls HTTP APIs city by city; here the payloads are landed JSON files read in one
distributed scan with an explicit schema (no inference), malformed records go to a quarantine table
instead of stopping the run.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aqi import aqi
from ..functions.calendar import hour_floor, ntz_lit
from ..schemas import FEATURES_SCHEMA, POLLUTANT_COLUMNS, READINGS_COLUMNS, READINGS_SCHEMA, WEATHER_COLUMNS

CORRUPT = "_corrupt_record"

# Archive payload: an object of parallel arrays under ``hourly``; landed files add ``city``.
WEATHER_VARS = WEATHER_COLUMNS
AIR_VARS = POLLUTANT_COLUMNS


def _hourly_schema(names) -> T.StructType:
    return T.StructType([T.StructField("time", T.ArrayType(T.StringType()))]
                        + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in names])


ARCHIVE_SCHEMAS = {
    "weather": T.StructType([T.StructField("city", T.StringType()), T.StructField("hourly", _hourly_schema(WEATHER_VARS)),
                             T.StructField(CORRUPT, T.StringType())]),
    "air": T.StructType([T.StructField("city", T.StringType()), T.StructField("hourly", _hourly_schema(AIR_VARS)),
                         T.StructField(CORRUPT, T.StringType())]),
}

# Current payloads: weather ``current`` object; pollution ``list[0].components`` with short names.
POLLUTION_RENAMES = {"pm2_5": "pm2_5", "pm10": "pm10", "no2": "nitrogen_dioxide", "so2": "sulphur_dioxide",
                     "co": "carbon_monoxide", "o3": "ozone"}
CURRENT_WEATHER_SCHEMA = T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("current", T.StructType([T.StructField(n, T.DoubleType()) for n in WEATHER_VARS])),
    T.StructField(CORRUPT, T.StringType()),
])
CURRENT_POLLUTION_SCHEMA = T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("list", T.ArrayType(T.StructType([T.StructField("components", T.StructType(
        [T.StructField(n, T.DoubleType()) for n in POLLUTION_RENAMES]))]))),
    T.StructField(CORRUPT, T.StringType()),
])


UNREADABLE = "unreadable record"


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def parse_time(col) -> Column:
    """ISO timestamps with either 'T' or blank separator -> timestamp_ntz (unparseable -> null)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.try_cast("timestamp_ntz")


def flatten_archive(payload: DataFrame, names) -> tuple[DataFrame, DataFrame]:
    """Parallel arrays -> one row per hour (``inline(arrays_zip)``). Returns (rows, rejected).

    An absent variable array is a column of missing values. A record that cannot be read, has no time
    array or whose arrays differ in length is rejected as a whole (``arrays_zip`` would pad with nulls)."""
    h = F.col("hourly")
    n_time = F.size(h["time"])
    ragged = F.lit(False)
    for n in names:
        ragged = ragged | F.coalesce(F.size(h[n]) != n_time, F.lit(False))
    bad = F.coalesce(F.col(CORRUPT).isNotNull() | h.isNull() | h["time"].isNull() | ragged, F.lit(True))
    ok = payload.filter(~bad)
    blank = F.array_repeat(F.lit(None).cast("double"), n_time)
    rows = ok.select("city", F.inline(F.arrays_zip(h["time"].alias("time"),
                                                   *[F.coalesce(h[n], blank).alias(n) for n in names])))
    rows = rows.withColumn("time", parse_time("time"))
    reason = F.when(F.col(CORRUPT).isNotNull(), F.lit(UNREADABLE)).otherwise(F.lit("ragged or missing arrays"))
    return rows, payload.filter(bad).select("city", reason.alias("reason"), F.col(CORRUPT).alias("record"))


def backfill_readings(weather_rows: DataFrame, air_rows: DataFrame, missing: str = "zero") -> DataFrame:
    """J1 + P2 on the archive rows: inner join on (city, time) for all cities in one join."""
    j = weather_rows.join(air_rows, on=["city", "time"], how="inner")
    return j.withColumn("aqi", aqi(missing=missing)).select(*READINGS_COLUMNS)


def read_archive(spark: SparkSession, weather_path: str, air_path: str, missing: str = "zero"):
    """S3 + S4 + J1 + P2. Returns (readings, rejected): whole records and single rows without key or time of
    both sides, split off before the join so that none gets lost in it."""
    w_rows, w_bad = flatten_archive(read_json(spark, weather_path, ARCHIVE_SCHEMAS["weather"]), WEATHER_VARS)
    a_rows, a_bad = flatten_archive(read_json(spark, air_path, ARCHIVE_SCHEMAS["air"]), AIR_VARS)
    (w_ok, w_rejected), (a_ok, a_rejected) = quarantine_side(w_rows, w_bad), quarantine_side(a_rows, a_bad)
    rejected = w_rejected.withColumn("source", F.lit("weather")).unionByName(
        a_rejected.withColumn("source", F.lit("air")))
    return backfill_readings(w_ok, a_ok, missing), rejected


def quarantine_side(rows: DataFrame, bad_records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected records and rows) of one archive side."""
    valid, bad = quarantine_split(rows)
    return valid, bad_records.unionByName(bad.select("city", "reason", F.lit(None).cast("string").alias("record")))


def rejected_current(payload: DataFrame, field: str) -> DataFrame:
    """S8 for current payloads: unreadable records, and records without a city or without ``field``."""
    reason = (F.when(F.col(CORRUPT).isNotNull(), F.lit(UNREADABLE)).when(F.col("city").isNull(), F.lit("null city"))
              .when(F.col(field).isNull(), F.lit(f"no {field}")))
    return payload.select("city", reason.alias("reason"), F.col(CORRUPT).alias("record")).filter("reason is not null")


def current_rows(weather: DataFrame, pollution: DataFrame, run_time) -> DataFrame:
    """One live row per city that has both payloads; time = run hour (a parameter)."""
    w = weather.filter(F.col(CORRUPT).isNull()).select(
        "city", *[F.col("current")[n].alias(n) for n in WEATHER_VARS])
    comp = F.try_element_at(F.col("list"), F.lit(1))["components"]
    p = pollution.filter(F.col(CORRUPT).isNull()).select(
        "city", *[comp[src].alias(dst) for src, dst in POLLUTION_RENAMES.items()])
    hour = hour_floor(ntz_lit(run_time))
    j = w.join(p, on="city", how="inner").withColumn("time", hour)
    j = j.withColumns({"dust": F.lit(None).cast("double"), "aerosol_optical_depth": F.lit(None).cast("double")})
    return j.withColumn("aqi", aqi(missing="skip")).select(*READINGS_COLUMNS)


def read_current(spark: SparkSession, weather_path: str, pollution_path: str, run_time) -> DataFrame:
    return current_rows(read_json(spark, weather_path, CURRENT_WEATHER_SCHEMA),
                        read_json(spark, pollution_path, CURRENT_POLLUTION_SCHEMA), run_time)


def read_readings_csv(spark: SparkSession, path: str, schema: T.StructType = READINGS_SCHEMA) -> DataFrame:
    """CSV with header, ``time`` read as text and parsed from either ISO form."""
    text_schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "time" else f.dataType)
                                for f in schema.fields])
    df = spark.read.schema(text_schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df.withColumn("time", parse_time("time"))


def read_features_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_readings_csv(spark, path, FEATURES_SCHEMA)


def empty(spark: SparkSession, schema: T.StructType = READINGS_SCHEMA) -> DataFrame:
    """A missing input is an empty table with the expected schema."""
    return spark.createDataFrame([], schema)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    from .paths import exists
    if not exists(spark, path):
        return empty(spark, schema)
    return spark.read.schema(schema).format(fmt).load(path)


def quarantine_split(readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without a series key or time cannot be placed in a series: (valid, quarantined)."""
    bad = F.col("city").isNull() | F.col("time").isNull()
    return readings.filter(~bad), readings.filter(bad).withColumn(
        "reason", F.when(F.col("time").isNull(), F.lit("null time")).otherwise(F.lit("null city")))


def normalise_nan(df: DataFrame, cols=None) -> DataFrame:
    """NaN -> null in double columns (after the index has been computed)."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in cols})


def normalise_names(df: DataFrame) -> DataFrame:
    """Lower case, blanks -> underscore."""
    return df.toDF(*[re.sub(" ", "_", c.lower()) for c in df.columns])


# --- sinks ---------------------------------------------------------------------------------------

def write_per_city(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One directory per city (lower-case name), written in one distributed job."""
    (df.withColumn("city_part", F.lower(F.col("city"))).write.mode(mode).partitionBy("city_part")
     .format(fmt).option("header", True).save(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Combined sink (Parquet by default, CSV with header as an option)."""
    df.write.mode(mode).format(fmt).option("header", True).save(path)
