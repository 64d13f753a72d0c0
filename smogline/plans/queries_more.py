"""Registered queries for sources, keyed tables, selections, aggregates, streams and models."""

from __future__ import annotations

import datetime as dt
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from ..functions import aqi as AQ
from ..operators import aggregates as AG
from ..operators import joins as J
from ..operators import select as SEL
from ..operators.split import chrono_split
from ..schemas import FEATURE_COLUMNS, POLLUTANT_COLUMNS, READINGS_COLUMNS, ROLLING_WINDOWS, TARGETS, WEATHER_COLUMNS
from ..session import cut_lineage, scratch_path
from ..sources import dims, ingest
from ..sources.adapter import raw_events, readings_events
from ..tables import keyed as K
from . import features as FT
from . import fixtures as FX
from .queries_core import CALENDAR_SQL, COMPLETE_FEATURES_SQL, FEATURES_SQL, R, RAW, STD_COLS
from .registry import register, stable, stable_sql
from ..functions.calendar import ntz_lit

READ_COLS = ", ".join(READINGS_COLUMNS)
RAW_COLS = ", ".join(c for c in READINGS_COLUMNS if c != "aqi")
LIVE_AQI = AQ.aqi_sql(missing="skip")


def _rd(spark, sf):
    return readings_events(spark, sf)


def _feats(spark, sf, complete=False):
    return FT.build_features(_rd(spark, sf), drop_incomplete=complete)


# --- S3-S11 ---------------------------------------------------------------------------------------

@register("archive_flatten", f"SELECT {RAW_COLS}, {AQ.aqi_sql(missing='zero')} AS aqi FROM ({RAW}) r")
def q_archive_flatten(spark, sf):
    """S3 + S4 + J1 + P2 (history rule): landed archive JSON -> rows."""
    wpath, apath = FX.land_archive(raw_events(spark, sf))
    rows, _rejected = ingest.read_archive(spark, wpath, apath, missing="zero")
    return rows


LATEST_RAW_SQL = (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY time DESC) AS rk "
                  f"FROM ({RAW}) r) x WHERE rk = 1")
_CUR_COLS = ", ".join(WEATHER_COLUMNS + POLLUTANT_COLUMNS[:6])


@register("current_flatten", f"SELECT city, {_CUR_COLS} FROM ({LATEST_RAW_SQL}) l")
def q_current_flatten(spark, sf):
    """S5 + S6: current payloads -> one flat row per city (pollutant short names renamed)."""
    wpath, ppath = FX.land_current(raw_events(spark, sf))
    w = ingest.read_json(spark, wpath, ingest.CURRENT_WEATHER_SCHEMA).select(
        "city", *[F.col("current")[n].alias(n) for n in WEATHER_COLUMNS])
    comp = F.try_element_at(F.col("list"), F.lit(1))["components"]
    p = ingest.read_json(spark, ppath, ingest.CURRENT_POLLUTION_SCHEMA).select(
        "city", *[comp[s].alias(d) for s, d in ingest.POLLUTION_RENAMES.items()])
    return w.join(p, on="city")


def _run_hour(df):
    """The run time of a live pull: one hour after the latest landed reading (a data-derived scalar)."""
    return df.agg(F.max("time")).first()[0] + dt.timedelta(hours=1)


LIVE_ROWS_SQL = (f"SELECT (SELECT max(time) FROM ({RAW}) m) + INTERVAL 1 HOUR AS time, city, "
                 + ", ".join(WEATHER_COLUMNS + POLLUTANT_COLUMNS[:6])
                 + ", CAST(NULL AS DOUBLE) AS dust, CAST(NULL AS DOUBLE) AS aerosol_optical_depth, "
                 + f"{LIVE_AQI} AS aqi FROM ({LATEST_RAW_SQL}) l")


@register("live_rows", LIVE_ROWS_SQL)
def q_live_rows(spark, sf):
    """Weather + pollution payloads per city, hour-floored run time, typed nulls, live index."""
    raw = raw_events(spark, sf)
    wpath, ppath = FX.land_current(raw)
    return ingest.read_current(spark, wpath, ppath, _run_hour(raw))


@register("mixed_time_scan", f"SELECT {READ_COLS} FROM ({R}) r")
def q_mixed_time(spark, sf):
    """CSV with 'T' and blank separated timestamps parses to the same times."""
    path = FX.land_mixed_csv(_rd(spark, sf))
    return ingest.read_readings_csv(spark, path)


QUARANTINE_SQL = f"""
WITH g AS (SELECT dayofyear(time) % 7 AS k, city, CAST(time AS DATE) AS d, count(*) AS n FROM ({RAW}) r GROUP BY 1, 2, 3),
c AS (SELECT CASE k WHEN 0 THEN 'ragged or missing arrays' WHEN 2 THEN 'null time' WHEN 3 THEN 'null city'
        WHEN 4 THEN 'unreadable record' END AS reason, CASE k WHEN 3 THEN n ELSE 1 END AS n FROM g WHERE k IN (0, 2, 3, 4)
  UNION ALL SELECT 'valid' AS reason, CASE k WHEN 2 THEN n - 1 ELSE n END AS n FROM g WHERE k IN (1, 2, 5, 6))
SELECT source, reason, CAST(sum(n) AS BIGINT) AS n FROM c CROSS JOIN (VALUES ('weather'), ('air')) s(source)
GROUP BY 1, 2 HAVING sum(n) > 0"""


@register("quarantine", QUARANTINE_SQL)
def q_quarantine(spark, sf):
    """S8 / null keys on landed payloads with ragged, missing-array, bad-time, null-city and unreadable records:
    rejected records and rows, and valid rows, per side (nothing is lost)."""
    out = None
    for kind, path in FX.land_malformed(raw_events(spark, sf)).items():
        names = ingest.WEATHER_VARS if kind == "weather" else ingest.AIR_VARS
        rows, bad = ingest.flatten_archive(ingest.read_json(spark, path, ingest.ARCHIVE_SCHEMAS[kind]), names)
        valid, rejected = ingest.quarantine_side(rows, bad)
        part = (rejected.select("reason").unionAll(valid.select(F.lit("valid").alias("reason")))
                .groupBy("reason").agg(F.count("*").alias("n")).withColumn("source", F.lit(kind)))
        out = part if out is None else out.unionByName(part)
    return out.select("source", "reason", "n")


# --- U1, K1-K6 ------------------------------------------------------------------------------------

def last_hours_sql(n: int) -> str:
    return f"SELECT DISTINCT time FROM ({R}) r ORDER BY time DESC LIMIT {n}"


LAST24_SQL = last_hours_sql(24)
_STD_ROUNDED = ", ".join(f"{stable_sql(c)} AS {c}" if c in STD_COLS else c for c in FEATURE_COLUMNS)


@register("union_by_name", f"SELECT {_STD_ROUNDED} FROM ({COMPLETE_FEATURES_SQL}) f "
                           f"UNION ALL BY NAME SELECT {READ_COLS} FROM ({R}) r WHERE time IN ({LAST24_SQL})")
def q_union(spark, sf):
    rd = _rd(spark, sf)
    _hist, hours = FX.live_hours(raw_events(spark, sf), 24)
    live = rd.filter(F.col("time").isin([ntz_lit(h) for h in hours]))
    return K.union_by_name(stable(_feats(spark, sf, complete=True), STD_COLS), live)


UPSERT_SQL = (
    f"WITH b1 AS (SELECT {RAW_COLS} FROM ({RAW}) r), "
    f"b2 AS (SELECT * REPLACE (pm2_5 + 10e0 AS pm2_5) FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY time DESC) AS rk FROM b1) x WHERE rk <= 100), "
    f"u AS (SELECT {RAW_COLS} FROM b2 UNION ALL SELECT {RAW_COLS} FROM b1 WHERE NOT EXISTS "
    f"(SELECT 1 FROM b2 WHERE b2.city = b1.city AND b2.time = b1.time)) "
)


@register("upsert_last_wins", UPSERT_SQL + f"SELECT {RAW_COLS}, {LIVE_AQI} AS aqi FROM u")
def q_upsert(spark, sf):
    """K1 + K2: two inserts into a keyed Parquet log, read back through the last-wins view."""
    b1, b2 = FX.upsert_batches(raw_events(spark, sf))
    table = K.KeyedTable(spark, scratch_path(spark, "keyed"))
    table.insert(b1.withColumn("aqi", AQ.aqi()))
    table.insert(b2.withColumn("aqi", AQ.aqi()))
    return table.current().select(*READINGS_COLUMNS)


@register("retention", f"SELECT {READ_COLS} FROM ({R}) r WHERE time >= (SELECT max(time) FROM ({RAW}) m) - INTERVAL 168 HOUR")
def q_retention(spark, sf):
    return K.retain(_rd(spark, sf))


@register("seed_buffer", f"SELECT {READ_COLS}, time IN ({last_hours_sql(1)}) AS is_new FROM ({R}) r "
                         f"WHERE time >= (SELECT max(time) FROM ({RAW}) m) - INTERVAL 168 HOUR")
def q_seed(spark, sf):
    """K5 then T3: no buffer yet -> seed from the history tail, add the newest hour, trim again."""
    rd = _rd(spark, sf)
    _hist, hours = FX.live_hours(raw_events(spark, sf), 1)
    new = rd.filter(F.col("time") == ntz_lit(hours[0]))
    seeded = K.seed_buffer(rd.filter(F.col("time") < ntz_lit(hours[0])))
    buf = K.upsert_buffer(seeded, new)
    return buf.join(new.select("city", "time").withColumn("is_new", F.lit(True)), ["city", "time"], "left") \
        .withColumn("is_new", F.coalesce(F.col("is_new"), F.lit(False))).select(*READINGS_COLUMNS, "is_new")


_LIVE_FEATURES_NULL_TARGETS = ", ".join(
    f"CAST(NULL AS INTEGER) AS {c}" if c in TARGETS else (f"{stable_sql(c)} AS {c}" if c in STD_COLS else c)
    for c in FEATURE_COLUMNS)
FALLBACK_SQL = (
    f"WITH b AS (SELECT {_STD_ROUNDED} FROM ({COMPLETE_FEATURES_SQL}) f), "
    f"l AS (SELECT {_LIVE_FEATURES_NULL_TARGETS} FROM ({FEATURES_SQL}) f WHERE time IN ({LAST24_SQL})) "
    f"SELECT * FROM l UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.city = b.city AND l.time = b.time)")


@register("fallback_read", FALLBACK_SQL)
def q_fallback(spark, sf):
    """K6: no store -> batch feature table plus live feature rows, last wins (live replaces batch)."""
    feats = stable(_feats(spark, sf), STD_COLS)
    batch = feats.filter(F.col("aqi_lag_24h").isNotNull() & F.col("target_aqi_72h").isNotNull())
    _hist, hours = FX.live_hours(raw_events(spark, sf), 24)
    live = feats.filter(F.col("time").isin([ntz_lit(h) for h in hours])).withColumns(
        {t: F.lit(None).cast("int") for t in TARGETS})
    return K.read_with_fallback(spark, None, batch, live).select(*FEATURE_COLUMNS)


# --- L1-L4, J1-J3, P16 -----------------------------------------------------------------------------

@register("tail_n", f"SELECT {READ_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY time DESC) AS rk "
                    f"FROM ({R}) r) x WHERE rk <= 49")
def q_tail(spark, sf):
    return SEL.tail_n(_rd(spark, sf), 49)


@register("latest_row", f"SELECT {READ_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY time DESC) AS rk "
                        f"FROM ({R}) r) x WHERE rk = 1")
def q_latest(spark, sf):
    return SEL.latest_row(_rd(spark, sf))


@register("city_series", f"SELECT time, aqi FROM ({R}) r WHERE city = (SELECT min(city) FROM ({RAW}) m)")
def q_city_series(spark, sf):
    rd = _rd(spark, sf)
    first_city = rd.agg(F.min("city")).first()[0]
    return SEL.city_series(rd, first_city).select("time", "aqi")


SPLIT_SQL = (f"SELECT city, time, rn <= CAST(floor(n * 0.8e0) AS BIGINT) AS is_train FROM "
             f"(SELECT city, time, row_number() OVER (ORDER BY time, city) AS rn, count(*) OVER () AS n "
             f"FROM ({COMPLETE_FEATURES_SQL}) f WHERE target_aqi_24h IS NOT NULL) s")


@register("split_80_20", SPLIT_SQL)
def q_split(spark, sf):
    lab = _feats(spark, sf, complete=True).filter(F.col("target_aqi_24h").isNotNull()).select("city", "time")
    return chrono_split(lab, 0.8)


@register("new_keys_semi", f"SELECT city, time, aqi, aqi_lag_1h, aqi_roll_mean_24h FROM ({FEATURES_SQL}) f "
                           f"WHERE time IN ({LAST24_SQL})")
def q_new_keys(spark, sf):
    """Keep the feature rows whose (city, time) is among the new rows."""
    feats = _feats(spark, sf)
    _hist, hours = FX.live_hours(raw_events(spark, sf), 24)
    new = _rd(spark, sf).filter(F.col("time").isin([ntz_lit(h) for h in hours]))
    return J.new_keys_semi(feats, new).select("city", "time", "aqi", "aqi_lag_1h", "aqi_roll_mean_24h")


_CITY_VALUES = ("(VALUES " + ", ".join(f"('{c}', {AQ.sql_double(la)}, {AQ.sql_double(lo)}, '{p}')" for c, la, lo, p in dims.CITIES)
                + ") AS d(city, lat, lon, province)")


@register("dim_join", f"SELECT r.city, r.time, r.aqi, d.lat, d.lon, d.province FROM ({R}) r LEFT JOIN {_CITY_VALUES} ON r.city = d.city")
def q_dim_join(spark, sf):
    return J.dim_join(_rd(spark, sf), dims.cities(spark)).select("city", "time", "aqi", "lat", "lon", "province")


@register("unknown_entities", f"SELECT DISTINCT r.city FROM ({RAW}) r WHERE r.city NOT IN (SELECT city FROM {_CITY_VALUES})")
def q_unknown(spark, sf):
    return J.unknown_entities(raw_events(spark, sf).select("city").distinct(), dims.cities(spark))


@register("weather_air_join", f"SELECT {RAW_COLS} FROM ({RAW}) r")
def q_weather_air(spark, sf):
    raw = raw_events(spark, sf)
    weather = raw.select("city", "time", *WEATHER_COLUMNS)
    air = raw.select("city", "time", *POLLUTANT_COLUMNS)
    return J.weather_air_join(weather, air).select(*[c for c in READINGS_COLUMNS if c != "aqi"])


# --- A1-A5, M5, M10 --------------------------------------------------------------------------------

@register("counts", f"SELECT count(*) AS n_rows, count(DISTINCT city) AS n_cities FROM ({COMPLETE_FEATURES_SQL}) f")
def q_counts(spark, sf):
    return AG.counts(_feats(spark, sf, complete=True))


@register("distinct_cities", f"SELECT DISTINCT city FROM ({RAW}) r")
def q_distinct(spark, sf):
    return AG.distinct_cities(raw_events(spark, sf))


@register("max_time", f"SELECT max(time) AS max_time FROM ({RAW}) r")
def q_max_time(spark, sf):
    return AG.max_time(raw_events(spark, sf))


BOX_SQL = (
    f"WITH r AS ({R}), q AS (SELECT city, quantile_cont(aqi, 0.25) AS q1, quantile_cont(aqi, 0.5) AS median, "
    f"quantile_cont(aqi, 0.75) AS q3, min(aqi) AS min, max(aqi) AS max, count(aqi) AS n FROM r GROUP BY city), "
    f"f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5e0 * (q3 - q1) AS lower_fence, q3 + 1.5e0 * (q3 - q1) AS upper_fence FROM q), "
    f"w AS (SELECT r.city, min(CASE WHEN aqi >= lower_fence AND aqi <= upper_fence THEN aqi END) AS whisker_low, "
    f"max(CASE WHEN aqi >= lower_fence AND aqi <= upper_fence THEN aqi END) AS whisker_high, "
    f"count(CASE WHEN aqi IS NOT NULL AND NOT (aqi >= lower_fence AND aqi <= upper_fence) THEN 1 END) AS n_outliers "
    f"FROM r JOIN f ON r.city = f.city GROUP BY r.city) "
    f"SELECT f.*, w.whisker_low, w.whisker_high, w.n_outliers FROM f JOIN w ON f.city = w.city")


@register("box_stats", BOX_SQL)
def q_box(spark, sf):
    return AG.box_stats(_rd(spark, sf))


def _persistence_sql() -> str:
    parts = [f"SELECT '{t.rsplit('_', 1)[-1]}' AS horizon, city, time, aqi, {t} AS y FROM f WHERE {t} IS NOT NULL"
             for t in TARGETS]
    return (
        f"WITH f AS ({COMPLETE_FEATURES_SQL}), p AS ({' UNION ALL '.join(parts)}), "
        f"s AS (SELECT horizon, y, CAST(aqi AS DOUBLE) AS pr, row_number() OVER (PARTITION BY horizon ORDER BY time, city) AS rn, "
        f"count(*) OVER (PARTITION BY horizon) AS n FROM p), "
        f"t AS (SELECT * FROM s WHERE rn > CAST(floor(n * 0.8e0) AS BIGINT)), "
        f"m AS (SELECT horizon, avg(y) AS ybar FROM t GROUP BY horizon), "
        f"g AS (SELECT t.horizon, avg(abs(pr - y)) AS mae, sqrt(avg((pr - y) * (pr - y))) AS rmse, "
        f"sum((pr - y) * (pr - y)) AS sse, sum((y - ybar) * (y - ybar)) AS sst, count(*) AS n "
        f"FROM t JOIN m ON t.horizon = m.horizon GROUP BY t.horizon) "
        f"SELECT horizon, 'persistence' AS model, {stable_sql('mae')} AS mae, {stable_sql('rmse')} AS rmse, n, "
        f"{stable_sql('CASE WHEN sst <> 0 THEN 1e0 - sse / sst WHEN sse = 0 THEN 1e0 ELSE 0e0 END')} AS r2 FROM g")


@register("metrics_persistence", _persistence_sql())
def q_metrics_persistence(spark, sf):
    """M5 + A5: persistence forecast on each horizon's test split (the 20 % latest rows)."""
    from ..ml.models import persistence_metrics
    from ..session import cut_lineage
    # the feature table is a stored table in the pipeline; the split and metrics read it several times
    feats = cut_lineage(_feats(spark, sf, complete=True), "persistence-features")
    return stable(persistence_metrics(feats), ["mae", "rmse", "r2"])


ALERT_REPORT_SQL = (f"SELECT city, time, aqi, {AQ.alert_sql('aqi', 'level')} AS level, {AQ.alert_sql('aqi', 'colour')} AS colour "
                    f"FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY time DESC) AS rk FROM ({R}) r) x WHERE rk = 1")


@register("alert_report", ALERT_REPORT_SQL)
def q_alert_report(spark, sf):
    """Latest index and alert level per city."""
    a = AQ.alert_level("aqi")
    return SEL.latest_row(_rd(spark, sf)).select("city", "time", "aqi", a["level"].alias("level"),
                                                  a["colour"].alias("colour"))


# --- T1-T6 ----------------------------------------------------------------------------------------

def _live_sql() -> str:
    within = "time - INTERVAL 168 HOUR"
    lag_cols = ", ".join(
        f"CASE WHEN lag(time, {n}) OVER w >= {within} THEN lag(aqi, {n}) OVER w END AS aqi_lag_{n}h" for n in (1, 3, 6, 12, 24))
    roll = []
    for n in ROLLING_WINDOWS:
        ok = f"count(aqi) OVER w{n} = {n} AND lag(time, {n}) OVER w >= {within}"
        roll.append(f"CASE WHEN {ok} THEN avg(aqi) OVER w{n} END AS aqi_roll_mean_{n}h, "
                    f"CASE WHEN {ok} THEN max(aqi) OVER w{n} END AS aqi_roll_max_{n}h, "
                    f"CASE WHEN {ok} THEN min(aqi) OVER w{n} END AS aqi_roll_min_{n}h, "
                    f"CASE WHEN {ok} THEN {stable_sql(f'stddev_samp(aqi) OVER w{n}')} END AS aqi_roll_std_{n}h")
    prev_ok = f"lag(time, 1) OVER w >= {within}"
    diffs = (f"CASE WHEN {prev_ok} THEN aqi - lag(aqi, 1) OVER w END AS aqi_change_rate, "
             f"CASE WHEN {prev_ok} THEN temperature_2m - lag(temperature_2m, 1) OVER w END AS temp_diff, "
             f"CASE WHEN {prev_ok} THEN relative_humidity_2m - lag(relative_humidity_2m, 1) OVER w END AS humidity_diff")
    targets = ", ".join(f"CAST(NULL AS INTEGER) AS target_aqi_{h}h" for h in (24, 48, 72))
    frames = ", ".join(f"w{n} AS (PARTITION BY city ORDER BY time ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
                       for n in ROLLING_WINDOWS)
    inner = (f"SELECT r.*, {CALENDAR_SQL}, {lag_cols}, {', '.join(roll)}, pm2_5 / nullif(pm10, 0e0) AS pm_ratio, "
             f"wind_speed_10m * pm2_5 AS wind_pollution_interaction, {diffs}, {targets} "
             f"FROM ({R}) r WINDOW w AS (PARTITION BY city ORDER BY time), {frames}")
    return f"SELECT {', '.join(FEATURE_COLUMNS)} FROM ({inner}) f WHERE time IN ({LAST24_SQL})"


@register("live_features_stream", _live_sql())
def q_live_stream(spark, sf):
    """The last 24 hours arrive as 24 landed batches; each micro-batch upserts the 168 h
    buffer and emits the features of its new rows; the result is the accumulated live table."""
    from ..streaming.live import LiveJob, readings_stream
    # the readings are asked for by the history and by every hour: the events are read and grouped once
    raw = cut_lineage(raw_events(spark, sf), "live-readings")
    hist, hours = FX.live_hours(raw, 24)
    live = cut_lineage(raw.filter(F.col("time") >= ntz_lit(hours[0])), "live-hours") if hours else raw
    frames = [live.filter(F.col("time") == ntz_lit(h)) for h in hours]
    landing = FX.land_batches(frames, "live-landing", single_file=True)
    job = LiveJob(spark, scratch_path(spark, "live-state"), history=hist.withColumn("aqi", AQ.aqi()))
    job.run(readings_stream(spark, f"{landing}/*", max_files=1), scratch_path(spark, "live-ckpt"))
    return stable(job.live_features().select(*FEATURE_COLUMNS), STD_COLS)


BUFFER_STREAM_SQL = UPSERT_SQL + (f"SELECT {RAW_COLS}, {LIVE_AQI} AS aqi FROM u "
                                  f"WHERE time >= (SELECT max(time) FROM u) - INTERVAL 168 HOUR")


@register("buffer_upsert_stream", BUFFER_STREAM_SQL)
def q_buffer_stream(spark, sf):
    """T3 + T6: two landed batches (all rows; last 100 rows per city re-sent with pm2_5 + 10) through
    the streaming buffer upsert; repeated keys take the later batch, then the 168 h retention."""
    from ..streaming.live import LiveJob, readings_stream
    raw = cut_lineage(raw_events(spark, sf), "upsert-readings")
    landing = FX.land_batches(FX.upsert_batches(raw), "upsert-landing")
    job = LiveJob(spark, scratch_path(spark, "buffer-state"), features=False)
    job.run(readings_stream(spark, f"{landing}/*"), scratch_path(spark, "buffer-ckpt"))
    return job.latest_buffer().select(*READINGS_COLUMNS)


# --- M1-M4, M6-M9, M11 (rows only: model output is not SQL) ----------------------------------------

# Independent fits whose many small jobs are submitted side by side (as CrossValidator's ``parallelism``).
FITS_AT_ONCE = 4
_FITS: dict = {}
_INPUTS: dict = {}


def _side_by_side(spark, fn, items: list) -> list:
    with ThreadPool(FITS_AT_ONCE) as pool:
        return pool.map(inheritable_thread_target(spark)(fn), items, chunksize=1)


def _model_inputs(spark, sf):
    """(complete features, {target: training matrix with the split}) of one session, shared by all models: the events
    are read once and every matrix is built once."""
    from ..ml import models as M
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INPUTS:
        readings = cut_lineage(_rd(spark, sf), "model-readings")
        feats = cut_lineage(FT.build_features(readings, drop_incomplete=True), "model-features")
        split = _side_by_side(spark, lambda t: M.horizon_matrix(feats, t), list(TARGETS))
        _INPUTS[key] = feats, dict(zip(TARGETS, split))
    return _INPUTS[key]


def _fit_models(spark, sf, models) -> None:
    """Per-horizon fits, shared by the model queries of one session (fitting is the costly part)."""
    from ..ml import models as M
    app = spark.sparkContext.applicationId
    missing = [(m, t) for m in models if (app, sf, m) not in _FITS for t in TARGETS]
    if not missing:
        return
    feats, matrix = _model_inputs(spark, sf)

    def fit(model_target):
        model, target = model_target
        return M.fit_horizon(feats, target, model, matrix=matrix[target])

    for (model, target), f in zip(missing, _side_by_side(spark, fit, missing)):
        _FITS.setdefault((app, sf, model), {})[target] = f


def _fits(spark, sf, model: str) -> dict:
    _fit_models(spark, sf, [model])
    return _FITS[(spark.sparkContext.applicationId, sf, model)]


def _metrics_of(spark, sf, model):
    fits = _fits(spark, sf, model)
    out = None
    for fit in fits.values():
        out = fit.metrics if out is None else out.unionByName(fit.metrics)
    return out


@register("train_gbt")
def q_train_gbt(spark, sf):
    """M1-M3: boosted trees on the delta label per horizon; test metrics (MAE, RMSE, R2)."""
    return _metrics_of(spark, sf, "gbt")


@register("train_ridge")
def q_train_ridge(spark, sf):
    """M4: ridge regression per horizon."""
    return _metrics_of(spark, sf, "ridge")


@register("train_forest")
def q_train_forest(spark, sf):
    """M4: random forest per horizon."""
    return _metrics_of(spark, sf, "forest")


@register("model_select")
def q_model_select(spark, sf):
    """M6 + M5: best of persistence, ridge, forest and boosted trees per horizon by test RMSE."""
    from ..ml.models import persistence_metrics
    _fit_models(spark, sf, ("gbt", "forest", "ridge"))              # the longest fits start first
    m = persistence_metrics(_model_inputs(spark, sf)[0])
    for model in ("ridge", "forest", "gbt"):
        m = m.unionByName(_metrics_of(spark, sf, model))
    return AG.select_best(m)


@register("feature_importance")
def q_importance(spark, sf):
    """M8: importance per feature of the boosted model, per horizon."""
    from ..ml.models import feature_importance
    out = None
    for fit in _fits(spark, sf, "gbt").values():
        f = feature_importance(fit)
        out = f if out is None else out.unionByName(f)
    return out


@register("batch_forecast")
def q_batch_forecast(spark, sf):
    """M9 + P12: every city x 24/48/72 h from its latest row, forecast = max(aqi + delta, 0)."""
    from ..ml.models import batch_forecast
    return batch_forecast(_feats(spark, sf), _fits(spark, sf, "gbt"))


@register("model_listing")
def q_model_listing(spark, sf):
    """M7 + M11: save each horizon's pipeline, reload it, list horizon -> artifact path."""
    from ..ml.models import load_model, model_listing
    models = ("gbt", "forest", "ridge")
    _fit_models(spark, sf, models)                                  # the longest fits start first

    def save(model_target):
        model, target = model_target
        path = scratch_path(spark, f"model-{model}-{target}")
        _fits(spark, sf, model)[target].model.write().overwrite().save(path)
        load_model(path)
        return target.rsplit("_", 1)[-1], model, path

    rows = _side_by_side(spark, save, [(m, t) for m in models for t in TARGETS])
    return model_listing(spark.createDataFrame(rows, "horizon string, model string, path string"))
