"""Joins: weather x air quality (J1), new-key semi join (J2), dimension lookup (J3), breakpoint range
join (J4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aqi import INDEX_CAP, PM10_BREAKPOINTS, PM25_BREAKPOINTS
from ..sources import dims


def weather_air_join(weather: DataFrame, air: DataFrame, keys=("city", "time")) -> DataFrame:
    """Inner equi-join on (city, time) for all cities at once (the reference joins per city on time).

    Both sides are large; Spark plans a sort-merge join on the keys (AQE splits skewed partitions)."""
    return weather.join(air, on=list(keys), how="inner")


def new_keys_semi(frame: DataFrame, new_rows: DataFrame, keys=("city", "time")) -> DataFrame:
    """Rows of ``frame`` whose key is among the keys of ``new_rows`` (left semi join).

    The key set is left to the planner: AQE broadcasts it when its runtime size is under the broadcast
    threshold, otherwise both sides shuffle on the keys."""
    return frame.join(new_rows.select(*keys).distinct(), on=list(keys), how="left_semi")


def dim_join(readings: DataFrame, city_dim: DataFrame, how: str = "left") -> DataFrame:
    """Coordinates and province by city name. The caller gives the dimension, so the planner chooses the join
    (AQE broadcasts it below the broadcast threshold)."""
    return readings.join(city_dim, on="city", how=how)


def unknown_entities(requests: DataFrame, city_dim: DataFrame, key: str = "city") -> DataFrame:
    """Requested keys absent from the dimension (the API's 404 case), as a left anti join."""
    return requests.join(city_dim.select(key), on=key, how="left_anti")


def aqi_by_range_join(raw: DataFrame, missing: str = "skip") -> DataFrame:
    """Index through a non-equi join against the 14-row breakpoint dimension (cross-check of P1).

    The dimension is a fixed 7 rows per pollutant, so the broadcast nested-loop join costs at most 7
    comparisons per reading."""
    bp = dims.breakpoints(raw.sparkSession).withColumn(
        "slope", F.expr("CAST(aqi_hi - aqi_lo AS DOUBLE) / (bp_hi - bp_lo)"))

    def sub(df, col, pollutant, top):
        b = F.broadcast(bp.filter(F.col("pollutant") == pollutant).select(
            F.col("bp_lo").alias(f"_lo_{pollutant}"), F.col("bp_hi").alias(f"_hi_{pollutant}"),
            F.col("aqi_lo").alias(f"_alo_{pollutant}"), F.col("slope").alias(f"_sl_{pollutant}")))
        x = F.col(col)
        j = df.join(b, (x >= F.col(f"_lo_{pollutant}")) & (x <= F.col(f"_hi_{pollutant}")), "left")
        lin = F.col(f"_sl_{pollutant}") * (x - F.col(f"_lo_{pollutant}")) + F.col(f"_alo_{pollutant}").cast("double")
        val = (F.when(x.isNull(), F.lit(None)).when(F.isnan(x), F.lit(0))
               .when(F.col(f"_alo_{pollutant}").isNotNull(), F.rint(lin).cast("int"))
               .when(x > F.lit(float(top)), F.lit(INDEX_CAP)).otherwise(F.lit(0)))
        return j.withColumn(f"_sub_{pollutant}", val.cast("int")).drop(
            f"_lo_{pollutant}", f"_hi_{pollutant}", f"_alo_{pollutant}", f"_sl_{pollutant}")

    d = sub(raw, "pm2_5", "pm25", PM25_BREAKPOINTS[-1][1])
    d = sub(d, "pm10", "pm10", PM10_BREAKPOINTS[-1][1])
    s25, s10 = F.col("_sub_pm25"), F.col("_sub_pm10")
    if missing == "zero":
        s25, s10 = F.coalesce(s25, F.lit(0)), F.coalesce(s10, F.lit(0))
    return d.withColumn("aqi", F.greatest(s25, s10).cast("int")).drop("_sub_pm25", "_sub_pm10")
