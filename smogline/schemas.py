"""Table schemas: readings (19 columns), features (50 columns), training matrix (59 + labels)."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "city"
TIME = "time"

WEATHER_COLUMNS = [
    "temperature_2m", "relative_humidity_2m", "surface_pressure", "wind_speed_10m",
    "wind_direction_10m", "cloud_cover", "precipitation", "shortwave_radiation",
]
POLLUTANT_COLUMNS = [
    "pm2_5", "pm10", "nitrogen_dioxide", "sulphur_dioxide", "carbon_monoxide", "ozone",
    "dust", "aerosol_optical_depth",
]
READINGS_COLUMNS = [TIME, KEY, *WEATHER_COLUMNS, *POLLUTANT_COLUMNS, "aqi"]

READINGS_SCHEMA = T.StructType(
    [T.StructField(TIME, T.TimestampNTZType()), T.StructField(KEY, T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in WEATHER_COLUMNS + POLLUTANT_COLUMNS]
    + [T.StructField("aqi", T.IntegerType())]
)
RAW_SCHEMA = T.StructType([f for f in READINGS_SCHEMA.fields if f.name != "aqi"])

LAG_HOURS = [1, 3, 6, 12, 24]
ROLLING_WINDOWS = [3, 6, 24]
HORIZONS = [24, 48, 72]
TARGETS = [f"target_aqi_{h}h" for h in HORIZONS]

CALENDAR_COLUMNS = ["hour", "day", "month", "weekday", "is_weekend", "season"]
LAG_COLUMNS = [f"aqi_lag_{n}h" for n in LAG_HOURS]
ROLLING_COLUMNS = [f"aqi_roll_{s}_{n}h" for n in ROLLING_WINDOWS for s in ("mean", "max", "min", "std")]
DERIVED_COLUMNS = ["pm_ratio", "wind_pollution_interaction", "aqi_change_rate", "temp_diff", "humidity_diff"]
FEATURE_COLUMNS = READINGS_COLUMNS + CALENDAR_COLUMNS + LAG_COLUMNS + ROLLING_COLUMNS + DERIVED_COLUMNS + TARGETS

_INT_FEATURES = set(LAG_COLUMNS) | set(TARGETS) | {"aqi_change_rate"} | {
    f"aqi_roll_{s}_{n}h" for n in ROLLING_WINDOWS for s in ("max", "min")}


def _feature_type(name: str) -> T.DataType:
    if name == TIME:
        return T.TimestampNTZType()
    if name in (KEY, "season"):
        return T.StringType()
    if name in CALENDAR_COLUMNS:
        return T.LongType()
    if name == "aqi" or name in _INT_FEATURES:
        return T.IntegerType()
    return T.DoubleType()


FEATURES_SCHEMA = T.StructType([T.StructField(c, _feature_type(c)) for c in FEATURE_COLUMNS])

# Model inputs: the listed feature columns, then the 13 columns derived at training time.
MODEL_BASE_COLUMNS = [
    "city", "hour", "day", "month", "weekday", "is_weekend", "season",
    "aqi", "pm2_5", "pm10", "nitrogen_dioxide", "sulphur_dioxide",
    "carbon_monoxide", "ozone", "dust", "aerosol_optical_depth",
    *WEATHER_COLUMNS, *LAG_COLUMNS,
    "aqi_roll_mean_3h", "aqi_roll_mean_6h", "aqi_roll_mean_24h",
    "aqi_roll_max_3h", "aqi_roll_max_6h", "aqi_roll_max_24h",
    "aqi_roll_min_3h", "aqi_roll_min_6h", "aqi_roll_min_24h",
    "aqi_roll_std_3h", "aqi_roll_std_6h", "aqi_roll_std_24h",
    *DERIVED_COLUMNS,
]
MODEL_EXTRA_COLUMNS = [
    "hour_sin", "hour_cos", "month_sin", "month_cos", "wind_u", "wind_v",
    "aqi_ewma_6h", "aqi_roll_mean_48h", "aqi_roll_max_72h", "aqi_roll_std_48h",
    "aqi_trend_24h", "pressure_trend_12h", "temp_inversion_proxy",
]
CATEGORICAL_COLUMNS = ["city", "season"]

METRICS_SCHEMA = T.StructType([
    T.StructField("horizon", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("mae", T.DoubleType()), T.StructField("rmse", T.DoubleType()),
    T.StructField("r2", T.DoubleType()), T.StructField("path", T.StringType()),
])


def horizon_label(target: str) -> str:
    """target_aqi_24h -> 24h"""
    return target.rsplit("_", 1)[-1]
