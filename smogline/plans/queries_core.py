"""Registered queries for the index, feature and training-window operators (P, W sections)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import aqi as AQ
from ..functions import derived
from ..functions.calendar import SEASON_MONTHS, SEASON_OTHER, calendar_columns, cyclic_columns
from ..schemas import FEATURE_COLUMNS, LAG_HOURS, MODEL_BASE_COLUMNS, ROLLING_WINDOWS
from ..operators.sequence import DEFAULT_CHUNK_ROWS
from ..sources.adapter import (RAW_EVENTS_SQL, longest_lineitem_series, raw_events, readings_events, readings_events_sql, readings_hot_series,
                               readings_hot_series_sql, readings_lineitem, readings_lineitem_sql)
from . import features as FT
from .registry import register, stable, stable_sql

R = readings_events_sql()               # readings view (live index rule), DuckDB
RAW = RAW_EVENTS_SQL
STD_COLS = [f"aqi_roll_std_{n}h" for n in ROLLING_WINDOWS]
KEYS = ["city", "time"]


def _rd(spark, sf):
    return readings_events(spark, sf)


# --- P1, P2, J4 ----------------------------------------------------------------------------------

@register("sub_index_pm25", f"SELECT city, time, pm2_5, {AQ.sub_index_sql('pm2_5', 'pm25')} AS sub_pm25 FROM ({RAW}) r")
def q_sub25(spark, sf):
    return raw_events(spark, sf).select("city", "time", "pm2_5", AQ.sub_index("pm2_5", "pm25").alias("sub_pm25"))


@register("sub_index_pm10", f"SELECT city, time, pm10, {AQ.sub_index_sql('pm10', 'pm10')} AS sub_pm10 FROM ({RAW}) r")
def q_sub10(spark, sf):
    return raw_events(spark, sf).select("city", "time", "pm10", AQ.sub_index("pm10", "pm10").alias("sub_pm10"))


@register("aqi_live", f"SELECT city, time, pm2_5, pm10, {AQ.aqi_sql(missing='skip')} AS aqi FROM ({RAW}) r")
def q_aqi_live(spark, sf):
    return raw_events(spark, sf).select("city", "time", "pm2_5", "pm10", AQ.aqi(missing="skip").alias("aqi"))


@register("aqi_backfill", f"SELECT city, time, pm2_5, pm10, {AQ.aqi_sql(missing='zero')} AS aqi FROM ({RAW}) r")
def q_aqi_backfill(spark, sf):
    return raw_events(spark, sf).select("city", "time", "pm2_5", "pm10", AQ.aqi(missing="zero").alias("aqi"))


@register("aqi_truncate", f"SELECT city, time, pm2_5, pm10, {AQ.aqi_sql(gap='truncate')} AS aqi FROM ({RAW}) r")
def q_aqi_trunc(spark, sf):
    return raw_events(spark, sf).select("city", "time", "pm2_5", "pm10", AQ.aqi(gap="truncate").alias("aqi"))


def _range_join_sql() -> str:
    rows = []
    for name, table in (("pm25", AQ.PM25_BREAKPOINTS), ("pm10", AQ.PM10_BREAKPOINTS)):
        for lo, hi, alo, ahi in table:
            rows.append(f"('{name}', {AQ.sql_double(lo)}, {AQ.sql_double(hi)}, {alo}, {ahi}, "
                        f"{AQ.sql_double((ahi - alo) / (hi - lo))})")
    bp = "(VALUES " + ", ".join(rows) + ") AS bp(pollutant, bp_lo, bp_hi, aqi_lo, aqi_hi, slope)"
    top = {"pm25": AQ.PM25_BREAKPOINTS[-1][1], "pm10": AQ.PM10_BREAKPOINTS[-1][1]}

    def sub(col, name):
        return (f"CASE WHEN r.{col} IS NULL THEN NULL WHEN isnan(r.{col}) THEN 0 "
                f"WHEN b_{name}.aqi_lo IS NOT NULL THEN CAST(round_even(b_{name}.slope * (r.{col} - b_{name}.bp_lo) + b_{name}.aqi_lo, 0) AS INTEGER) "
                f"WHEN r.{col} > {AQ.sql_double(top[name])} THEN 500 ELSE 0 END")

    return (f"SELECT r.city, r.time, CAST(greatest({sub('pm2_5', 'pm25')}, {sub('pm10', 'pm10')}) AS INTEGER) AS aqi "
            f"FROM ({RAW}) r "
            f"LEFT JOIN (SELECT * FROM {bp} WHERE pollutant = 'pm25') b_pm25 ON r.pm2_5 >= b_pm25.bp_lo AND r.pm2_5 <= b_pm25.bp_hi "
            f"LEFT JOIN (SELECT * FROM {bp} WHERE pollutant = 'pm10') b_pm10 ON r.pm10 >= b_pm10.bp_lo AND r.pm10 <= b_pm10.bp_hi")


@register("aqi_range_join", _range_join_sql())
def q_aqi_range_join(spark, sf):
    from ..operators.joins import aqi_by_range_join
    return aqi_by_range_join(raw_events(spark, sf)).select("city", "time", "aqi")


@register("alert_level", f"SELECT city, time, aqi, {AQ.alert_sql('aqi', 'level')} AS level, "
                         f"{AQ.alert_sql('aqi', 'colour')} AS colour FROM ({R}) r")
def q_alert(spark, sf):
    a = AQ.alert_level("aqi")
    return _rd(spark, sf).select("city", "time", "aqi", a["level"].alias("level"), a["colour"].alias("colour"))


# --- P3-P12 ---------------------------------------------------------------------------------------

def _season_sql(m: str) -> str:
    parts = [f"WHEN {m} IN ({', '.join(str(x) for x in months)}) THEN '{name}'" for name, months in SEASON_MONTHS.items()]
    return "CASE " + " ".join(parts) + f" ELSE '{SEASON_OTHER}' END"


CALENDAR_SQL = ("CAST(hour(time) AS BIGINT) AS hour, CAST(day(time) AS BIGINT) AS day, "
                "CAST(month(time) AS BIGINT) AS month, CAST(isodow(time) - 1 AS BIGINT) AS weekday, "
                "CAST(isodow(time) - 1 IN (5, 6) AS BIGINT) AS is_weekend, " + _season_sql("month(time)") + " AS season")


@register("calendar", f"SELECT city, time, {CALENDAR_SQL} FROM ({RAW}) r")
def q_calendar(spark, sf):
    return raw_events(spark, sf).select("city", "time", *[c.alias(n) for n, c in calendar_columns("time").items()])


@register("season", "SELECT m AS month, " + _season_sql("m") + " AS season FROM "
          f"(SELECT DISTINCT CAST(month(time) AS BIGINT) AS m FROM ({RAW}) r) s")
def q_season(spark, sf):
    from ..functions.calendar import season
    return (raw_events(spark, sf).select(F.month("time").cast("bigint").alias("month")).distinct()
            .withColumn("season", season("month")))


@register("pm_ratio", f"SELECT city, time, pm2_5 / nullif(pm10, 0e0) AS pm_ratio FROM ({RAW}) r")
def q_pm_ratio(spark, sf):
    return raw_events(spark, sf).select("city", "time", derived.pm_ratio().alias("pm_ratio"))


@register("wind_pollution", f"SELECT city, time, wind_speed_10m * pm2_5 AS wind_pollution_interaction FROM ({RAW}) r")
def q_wind_pollution(spark, sf):
    return raw_events(spark, sf).select("city", "time", derived.wind_pollution().alias("wind_pollution_interaction"))


_TWO_PI = AQ.sql_double(2 * math.pi)
CYCLIC_SQL = ", ".join(
    f"{stable_sql(f'{fn}({_TWO_PI} * CAST({src}(time) AS BIGINT) / {den})')} AS {src}_{fn}"
    for src, den in (("hour", "24e0"), ("month", "12e0")) for fn in ("sin", "cos"))


@register("cyclic", f"SELECT city, time, {CYCLIC_SQL} FROM ({RAW}) r")
def q_cyclic(spark, sf):
    d = raw_events(spark, sf).withColumns(calendar_columns("time")).withColumns(cyclic_columns())
    return stable(d.select("city", "time", "hour_sin", "hour_cos", "month_sin", "month_cos"),
                  ["hour_sin", "hour_cos", "month_sin", "month_cos"])


@register("wind_vector", f"SELECT city, time, {stable_sql('-wind_speed_10m * sin(radians(wind_direction_10m))')} AS wind_u, "
                         f"{stable_sql('-wind_speed_10m * cos(radians(wind_direction_10m))')} AS wind_v FROM ({RAW}) r")
def q_wind_vector(spark, sf):
    d = raw_events(spark, sf).withColumns(derived.wind_vector())
    return stable(d.select("city", "time", "wind_u", "wind_v"), ["wind_u", "wind_v"])


@register("temp_inversion", f"SELECT city, time, CASE WHEN wind_speed_10m + 0.1e0 = 0 THEN NULL ELSE "
                            f"temperature_2m / (wind_speed_10m + 0.1e0) END AS temp_inversion_proxy FROM ({RAW}) r")
def q_temp_inversion(spark, sf):
    return raw_events(spark, sf).select("city", "time", derived.temp_inversion().alias("temp_inversion_proxy"))


# --- W1-W5, P14, P18 ------------------------------------------------------------------------------

def _window_sql(select_cols: str, source: str = R) -> str:
    frames = ", ".join(f"w{n} AS (PARTITION BY city ORDER BY time ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
                       for n in ROLLING_WINDOWS)
    return f"SELECT {select_cols} FROM ({source}) r WINDOW w AS (PARTITION BY city ORDER BY time), {frames}"


LAGS_SQL = ", ".join(f"lag(aqi, {n}) OVER w AS aqi_lag_{n}h" for n in LAG_HOURS)


def _rolling_sql(n: int) -> str:
    full = f"count(aqi) OVER w{n} = {n}"
    return (f"CASE WHEN {full} THEN avg(aqi) OVER w{n} END AS aqi_roll_mean_{n}h, "
            f"CASE WHEN {full} THEN max(aqi) OVER w{n} END AS aqi_roll_max_{n}h, "
            f"CASE WHEN {full} THEN min(aqi) OVER w{n} END AS aqi_roll_min_{n}h, "
            f"CASE WHEN {full} THEN {stable_sql(f'stddev_samp(aqi) OVER w{n}')} END AS aqi_roll_std_{n}h")


ROLLING_SQL = ", ".join(_rolling_sql(n) for n in ROLLING_WINDOWS)
DIFFS_SQL = ("aqi - lag(aqi, 1) OVER w AS aqi_change_rate, "
             "temperature_2m - lag(temperature_2m, 1) OVER w AS temp_diff, "
             "relative_humidity_2m - lag(relative_humidity_2m, 1) OVER w AS humidity_diff")
TARGETS_SQL = ", ".join(f"lead(aqi, {h}) OVER w AS target_aqi_{h}h" for h in (24, 48, 72))
FEATURES_INNER_SQL = _window_sql(
    f"r.*, {CALENDAR_SQL}, {LAGS_SQL}, {ROLLING_SQL}, "
    f"pm2_5 / nullif(pm10, 0e0) AS pm_ratio, wind_speed_10m * pm2_5 AS wind_pollution_interaction, "
    f"{DIFFS_SQL}, {TARGETS_SQL}")
FEATURES_SQL = f"SELECT {', '.join(FEATURE_COLUMNS)} FROM ({FEATURES_INNER_SQL}) f"
COMPLETE_FEATURES_SQL = FEATURES_SQL + " WHERE aqi_lag_24h IS NOT NULL AND target_aqi_72h IS NOT NULL"


def features_sql(source: str, complete: bool = True) -> str:
    """DuckDB feature table over any readings source (std columns rounded)."""
    inner = _window_sql(
        f"r.*, {CALENDAR_SQL}, {LAGS_SQL}, {ROLLING_SQL}, "
        f"pm2_5 / nullif(pm10, 0e0) AS pm_ratio, wind_speed_10m * pm2_5 AS wind_pollution_interaction, "
        f"{DIFFS_SQL}, {TARGETS_SQL}", source)
    sql = f"SELECT {', '.join(FEATURE_COLUMNS)} FROM ({inner}) f"
    return sql + (" WHERE aqi_lag_24h IS NOT NULL AND target_aqi_72h IS NOT NULL" if complete else "")


@register("features_lineitem", features_sql(readings_lineitem_sql()))
def q_features_lineitem(spark, sf):
    """P18 on the many-series fixture (one series per supplier, one row per ship day): short series are partitioned
    once, from the scan to the windows."""
    short = longest_lineitem_series(spark, sf) <= DEFAULT_CHUNK_ROWS
    return stable(FT.build_features(readings_lineitem(spark, sf, by_series=short), layout="series" if short else "auto"),
                  STD_COLS)


@register("features_hot_series", features_sql(readings_hot_series_sql()))
def q_features_hot(spark, sf):
    """P18 on one series holding every lineitem reading: the hot-key case, split into chunks."""
    return stable(FT.build_features(readings_hot_series(spark, sf)), STD_COLS)


def _features(spark, sf, drop_incomplete=False):
    return FT.build_features(_rd(spark, sf), drop_incomplete=drop_incomplete)


@register("lags", _window_sql(f"city, time, aqi, {LAGS_SQL}"))
def q_lags(spark, sf):
    return _features(spark, sf).select("city", "time", "aqi", *[f"aqi_lag_{n}h" for n in LAG_HOURS])


@register("rolling", _window_sql(f"city, time, {ROLLING_SQL}"))
def q_rolling(spark, sf):
    cols = [f"aqi_roll_{s}_{n}h" for n in ROLLING_WINDOWS for s in ("mean", "max", "min", "std")]
    return stable(_features(spark, sf).select("city", "time", *cols), STD_COLS)


@register("diffs", _window_sql(f"city, time, {DIFFS_SQL}"))
def q_diffs(spark, sf):
    return _features(spark, sf).select("city", "time", "aqi_change_rate", "temp_diff", "humidity_diff")


@register("targets", _window_sql(f"city, time, aqi, {TARGETS_SQL}"))
def q_targets(spark, sf):
    return _features(spark, sf).select("city", "time", "aqi", "target_aqi_24h", "target_aqi_48h", "target_aqi_72h")


@register("features_full", COMPLETE_FEATURES_SQL)
def q_features_full(spark, sf):
    return stable(_features(spark, sf, drop_incomplete=True), STD_COLS)


@register("complete_rows", "SELECT city, time FROM (" + COMPLETE_FEATURES_SQL + ") f")
def q_complete_rows(spark, sf):
    return _features(spark, sf, drop_incomplete=True).select("city", "time")


@register("label_rows", "SELECT city, time, target_aqi_48h FROM (" + FEATURES_SQL + ") f WHERE target_aqi_48h IS NOT NULL")
def q_label_rows(spark, sf):
    return (_features(spark, sf).filter(F.col("target_aqi_48h").isNotNull())
            .select("city", "time", "target_aqi_48h"))


# --- W6-W10, P7-P11, P17 on the 24 h horizon -------------------------------------------------------

def training_sql(target: str) -> str:
    """DuckDB form of the training matrix: label filter first, then the row windows."""
    ewma = "aqi_ewma_6h_raw"
    lab = f"SELECT * FROM ({FEATURES_SQL}) f WHERE {target} IS NOT NULL"
    # exponential mean as an explicit weighted sum over all earlier rows with a value
    numbered = f"SELECT *, row_number() OVER (PARTITION BY city ORDER BY time) AS rn FROM ({lab}) l"
    r = 1.0 - 2.0 / 7.0
    ew = (f"SELECT a.city, a.rn, sum(b.aqi * pow({AQ.sql_double(r)}, a.rn - b.rn)) / "
          f"sum(pow({AQ.sql_double(r)}, a.rn - b.rn)) AS {ewma} "
          f"FROM n a JOIN n b ON a.city = b.city AND b.rn <= a.rn AND b.rn > a.rn - 1024 AND b.aqi IS NOT NULL "
          f"GROUP BY a.city, a.rn")
    win = ("WINDOW w AS (PARTITION BY n.city ORDER BY n.rn), "
           "w48 AS (PARTITION BY n.city ORDER BY n.rn ROWS BETWEEN 47 PRECEDING AND CURRENT ROW), "
           "w72 AS (PARTITION BY n.city ORDER BY n.rn ROWS BETWEEN 71 PRECEDING AND CURRENT ROW)")
    two_pi = _TWO_PI
    extra = (f"{stable_sql(f'sin({two_pi} * hour / 24e0)')} AS hour_sin, {stable_sql(f'cos({two_pi} * hour / 24e0)')} AS hour_cos, "
             f"{stable_sql(f'sin({two_pi} * month / 12e0)')} AS month_sin, {stable_sql(f'cos({two_pi} * month / 12e0)')} AS month_cos, "
             f"{stable_sql('-wind_speed_10m * sin(radians(wind_direction_10m))')} AS wind_u, "
             f"{stable_sql('-wind_speed_10m * cos(radians(wind_direction_10m))')} AS wind_v, "
             f"{stable_sql(f'e.{ewma}')} AS aqi_ewma_6h, "
             f"avg(n.aqi) OVER w48 AS aqi_roll_mean_48h, max(n.aqi) OVER w72 AS aqi_roll_max_72h, "
             f"{stable_sql('coalesce(stddev_samp(n.aqi) OVER w48, 0e0)')} AS aqi_roll_std_48h, "
             f"n.aqi - n.aqi_lag_24h AS aqi_trend_24h, "
             f"n.surface_pressure - coalesce(lag(n.surface_pressure, 12) OVER w, 0e0) AS pressure_trend_12h, "
             f"CASE WHEN n.wind_speed_10m + 0.1e0 = 0 THEN NULL ELSE n.temperature_2m / (n.wind_speed_10m + 0.1e0) END AS temp_inversion_proxy, "
             f"n.{target} - n.aqi AS target_delta")
    base = ", ".join(f"n.{c}" if c in ("city", "aqi", "hour", "month") else c for c in MODEL_BASE_COLUMNS)
    return (f"WITH n AS ({numbered}), e AS ({ew}) "
            f"SELECT n.time, {base}, {extra}, n.{target} FROM n LEFT JOIN e ON n.city = e.city AND n.rn = e.rn {win}")


TRAIN_STABLE = STD_COLS + ["hour_sin", "hour_cos", "month_sin", "month_cos", "wind_u", "wind_v", "aqi_ewma_6h", "aqi_roll_std_48h"]


def _training(spark, sf, target="target_aqi_24h"):
    feats = _features(spark, sf, drop_incomplete=False)
    return stable(FT.training_matrix(feats, target), TRAIN_STABLE)


@register("training_matrix", training_sql("target_aqi_24h"))
def q_training_matrix(spark, sf):
    return _training(spark, sf)


def _train_subset_sql(cols: list[str]) -> str:
    return f"SELECT city, time, {', '.join(cols)} FROM ({training_sql('target_aqi_24h')}) t"


def _train_subset(cols):
    def fn(spark, sf):
        return _training(spark, sf).select("city", "time", *cols)
    return fn


for _name, _cols in {
    "ewma": ["aqi", "aqi_ewma_6h"],
    "roll_mean_48": ["aqi_roll_mean_48h"],
    "roll_max_72": ["aqi_roll_max_72h"],
    "roll_std_48": ["aqi_roll_std_48h"],
    "pressure_trend": ["pressure_trend_12h"],
    "aqi_trend": ["aqi_trend_24h"],
    "delta_label": ["target_aqi_24h", "target_delta"],
}.items():
    register(_name, _train_subset_sql(_cols))(_train_subset(_cols))


@register("forecast_clip", f"SELECT city, time, aqi, target_aqi_24h, "
          f"CASE WHEN target_aqi_24h IS NULL OR aqi IS NULL OR aqi_lag_24h IS NULL THEN NULL ELSE greatest(CAST(aqi AS DOUBLE) + CAST(aqi_lag_24h - aqi AS DOUBLE), 0e0) END AS forecast "
          f"FROM ({FEATURES_SQL}) f")
def q_forecast_clip(spark, sf):
    """P12 applied to a delta taken from the data (lag 24 minus current), null where the label is null."""
    f = _features(spark, sf)
    delta = F.when(F.col("target_aqi_24h").isNotNull(), F.col("aqi_lag_24h") - F.col("aqi"))
    return f.select("city", "time", "aqi", "target_aqi_24h", derived.forecast_from_delta("aqi", delta).alias("forecast"))
