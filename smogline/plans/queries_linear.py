"""Registered queries for closed-form ridge models (fits, held-out metrics, forecasts), selection among forecasts, permutation
importance and quantile sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.derived import forecast_from_delta
from ..ml import ridge
from ..ml.importance import permutation_importance
from ..operators import aggregates as AG
from ..operators import sketches as SK
from ..operators.select import latest_row
from ..schemas import TARGETS, horizon_label
from ..session import cut_lineage
from ..sources.adapter import raw_events, readings_events
from . import features as FT
from .queries_change import HOUR_SQL, hour_number
from .queries_core import COMPLETE_FEATURES_SQL, FEATURES_SQL, RAW
from .registry import register, stable, stable_sql

FEATURES = ["aqi", "aqi_lag_24h"]
HELD = 5        # rows of every fifth hour are held out


def _long(feats):
    """Feature rows fanned out per horizon with the delta label."""
    per_h = F.array(*[F.struct(F.lit(horizon_label(t)).alias("horizon"), F.col(t).alias("y_true")) for t in TARGETS])
    return (feats.select("city", "time", *FEATURES, "aqi_roll_mean_24h", F.inline(per_h))
            .withColumn("target_delta", F.col("y_true") - F.col("aqi")))


def _fits(rows):
    """Two stored batches of moments merged, the held-out rows' moments taken out, then a fit per horizon and city."""
    keys = ["horizon", "city"]
    batches = [cut_lineage(ridge.moments(rows.filter(hour_number() % 2 == b), FEATURES, "target_delta", keys), "moments")
               for b in (0, 1)]
    held = ridge.moments(rows.filter(hour_number() % HELD == 0), FEATURES, "target_delta", keys)
    table = ridge.downdate(ridge.merge(batches, keys), held, keys)
    whole = ridge.merge([table], ["horizon"]).withColumn("city", F.lit(None).cast("string"))
    return ridge.solve(table.unionByName(whole), FEATURES, 1.0, keys)


def _rows(spark, sf):
    return cut_lineage(_long(FT.build_features(readings_events(spark, sf))), "ridge-rows")


_LONG = " UNION ALL ".join(
    f"SELECT '{horizon_label(t)}' AS horizon, city, time, CAST(aqi AS DOUBLE) AS x1, CAST(aqi_lag_24h AS DOUBLE) AS x2, "
    f"aqi_roll_mean_24h AS x3, CAST({t} AS DOUBLE) AS y_true, CAST({t} - aqi AS DOUBLE) AS y FROM f" for t in TARGETS)
_GROUP = ("SELECT horizon, {city} AS city, CAST(count(*) AS DOUBLE) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(y) AS sy, "
          "sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y, "
          "sum(y * y) AS syy FROM t GROUP BY {by}")
FITS_SQL = (
    f"f AS ({COMPLETE_FEATURES_SQL}), l AS ({_LONG}), "
    f"t AS (SELECT * FROM l WHERE {HOUR_SQL} % {HELD} <> 0 AND x1 IS NOT NULL AND x2 IS NOT NULL AND y IS NOT NULL), "
    f"m AS ({_GROUP.format(city='city', by='horizon, city')} UNION ALL {_GROUP.format(city='NULL', by='horizon')}), "
    "c AS (SELECT *, s11 - s1 * s1 / n AS c11, s12 - s1 * s2 / n AS c12, s22 - s2 * s2 / n AS c22, "
    "s1y - s1 * sy / n AS c1y, s2y - s2 * sy / n AS c2y, syy - sy * sy / n AS cyy FROM m), "
    "b AS (SELECT *, (c1y * (c22 + 1e0) - c2y * c12) / ((c11 + 1e0) * (c22 + 1e0) - c12 * c12) AS b1, "
    "(c2y * (c11 + 1e0) - c1y * c12) / ((c11 + 1e0) * (c22 + 1e0) - c12 * c12) AS b2 FROM c), "
    "fit AS (SELECT *, (sy - s1 * b1 - s2 * b2) / n AS b0 FROM b)")


@register("ridge_fits", f"WITH {FITS_SQL} SELECT horizon, city, CAST(n AS BIGINT) AS n, {stable_sql('b0')} AS intercept, "
                        f"{stable_sql('b1')} AS b_aqi, {stable_sql('b2')} AS b_lag FROM fit")
def q_ridge_fits(spark, sf):
    """M4: coefficients per horizon and city, and per horizon over all cities (null city)."""
    fits = _fits(_rows(spark, sf))
    return stable(fits.select("horizon", "city", "n", "intercept", F.get("coefficients", F.lit(0)).alias("b_aqi"),
                              F.get("coefficients", F.lit(1)).alias("b_lag")), ["intercept", "b_aqi", "b_lag"])


def _metrics_sql(pred: str) -> str:
    return (f"e AS (SELECT horizon, model, avg(y_true) AS ybar FROM ({pred}) p GROUP BY horizon, model), "
            f"g AS (SELECT p.horizon, p.model, avg(abs(y_pred - y_true)) AS mae, "
            f"sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse, sum((y_pred - y_true) * (y_pred - y_true)) AS sse, "
            f"sum((y_true - ybar) * (y_true - ybar)) AS sst, count(*) AS n FROM ({pred}) p JOIN e ON p.horizon = e.horizon "
            f"AND p.model = e.model GROUP BY p.horizon, p.model)")


_METRICS = (f"horizon, model, {stable_sql('mae')} AS mae, {stable_sql('rmse')} AS rmse, n, "
            f"{stable_sql('CASE WHEN sst <> 0 THEN 1e0 - sse / sst WHEN sse = 0 THEN 1e0 ELSE 0e0 END')} AS r2")
_HELD_PRED = (f"SELECT l.horizon, 'ridge' AS model, y_true, greatest(x1 + b0 + b1 * x1 + b2 * x2, 0e0) AS y_pred "
              f"FROM l JOIN fit ON l.horizon = fit.horizon AND l.city = fit.city WHERE {HOUR_SQL} % {HELD} = 0 "
              f"AND x1 IS NOT NULL AND x2 IS NOT NULL AND y_true IS NOT NULL")


@register("ridge_metrics", f"WITH {FITS_SQL}, {_metrics_sql(_HELD_PRED)} SELECT {_METRICS} FROM g")
def q_ridge_metrics(spark, sf):
    """M4 + A5: each city's fit on the rows that were taken out of it."""
    rows = _rows(spark, sf)
    held = rows.filter((hour_number() % HELD == 0) & F.col("y_true").isNotNull())
    pred = ridge.predict(held, _fits(rows).filter(F.col("city").isNotNull()), FEATURES, ["horizon", "city"])
    pred = (pred.filter(F.col("pred_delta").isNotNull())
            .select("horizon", F.lit("ridge").alias("model"), "y_true", forecast_from_delta("aqi", "pred_delta").alias("y_pred")))
    return stable(AG.prediction_metrics(pred), ["mae", "rmse", "r2"])


_LAST = ("SELECT city, time, aqi, aqi_lag_24h, row_number() OVER (PARTITION BY city ORDER BY time DESC) AS rn "
         f"FROM ({FEATURES_SQL}) a")


@register("ridge_forecast",
          f"WITH {FITS_SQL}, last AS (SELECT * FROM ({_LAST}) r WHERE rn = 1) "
          f"SELECT last.city, last.time, fit.horizon, {stable_sql('greatest(aqi + b0 + b1 * aqi + b2 * aqi_lag_24h, 0e0)')} AS forecast "
          f"FROM last JOIN fit ON last.city = fit.city")
def q_ridge_forecast(spark, sf):
    """M9 + P12: every city's latest row (labelled or not) for each horizon, by that city's fit."""
    feats = cut_lineage(FT.build_features(readings_events(spark, sf), drop_incomplete=False), "forecast-features")
    labelled = feats.filter(F.col("aqi_lag_24h").isNotNull() & F.col("target_aqi_72h").isNotNull())
    fits = _fits(_long(labelled)).filter(F.col("city").isNotNull())
    last = latest_row(feats).select("city", "time", *FEATURES).withColumn(
        "horizon", F.explode(F.array(*[F.lit(horizon_label(t)) for t in TARGETS])))
    out = ridge.predict(last, fits, FEATURES, ["horizon", "city"])
    return stable(out.select("city", "time", "horizon", forecast_from_delta("aqi", "pred_delta").alias("forecast")), ["forecast"])


_PLAIN = " UNION ALL ".join(f"SELECT horizon, '{m}' AS model, y_true, {x} AS y_pred FROM l WHERE y_true IS NOT NULL AND {x} IS NOT NULL"
                            for m, x in (("persistence", "x1"), ("day_before", "x2"), ("day_mean", "x3")))


@register("select_plain_forecasts",
          f"WITH f AS ({COMPLETE_FEATURES_SQL}), l AS ({_LONG}), {_metrics_sql(_PLAIN)}, "
          f"o AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY rmse, model) AS rn FROM g) "
          f"SELECT horizon, model, {stable_sql('rmse')} AS rmse FROM o WHERE rn = 1")
def q_select_plain(spark, sf):
    """M6 + A5: metrics of three plain forecasts, all from one pass, and the best of each horizon."""
    of = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("y_pred")) for m, c in (
        ("persistence", "aqi"), ("day_before", "aqi_lag_24h"), ("day_mean", "aqi_roll_mean_24h"))])
    pred = _rows(spark, sf).select("horizon", "y_true", F.inline(of)).filter(
        F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    return stable(AG.select_best(AG.prediction_metrics(pred)), ["rmse"])


# --- M8 on a fixed score, A4 for continuous columns ------------------------------------------------------

SCORED = {"aqi": 0.6, "aqi_lag_24h": 0.3, "aqi_roll_mean_24h": 0.1, "temperature_2m": 0.0}
_SCORE_SQL = " + ".join(f"{w}e0 * {{{c}}}" for c, w in SCORED.items())


def _importance_sql() -> str:
    ranks = ", ".join(f"row_number() OVER (ORDER BY md5(concat_ws('|', city, CAST(time AS VARCHAR), '{s}'))) AS r{s}" for s in (42, 43))
    one = [f"SELECT {v} AS feature, a.target_aqi_24h AS y, greatest("
           + _SCORE_SQL.format(**{c: f"{'b' if v == repr(c) else 'a'}.{c}" for c in SCORED}) + ", 0e0) AS p, "
           + " + ".join(f"{'b' if v == repr(c) else 'a'}.{c}" for c in SCORED) + " AS whole "
           "FROM f a JOIN f b ON a.r42 = b.r43" for v in ("NULL", *map(repr, SCORED))]
    return (f"WITH f AS (SELECT *, {ranks} FROM ({COMPLETE_FEATURES_SQL}) x), v AS ({' UNION ALL '.join(one)}), "
            "e AS (SELECT feature, sqrt(avg((p - y) * (p - y))) AS rmse, count(*) AS n FROM v "
            "WHERE whole IS NOT NULL AND y IS NOT NULL GROUP BY feature) "
            f"SELECT e.feature, {stable_sql('z.rmse')} AS rmse, {stable_sql('e.rmse')} AS rmse_permuted, "
            f"{stable_sql('e.rmse - z.rmse')} AS importance, e.n FROM e JOIN e z ON z.feature IS NULL WHERE e.feature IS NOT NULL")


@register("permutation_importance", _importance_sql())
def q_permutation(spark, sf):
    """M8: importance of four features for a fixed linear score of the 24 h target, over all complete rows."""
    feats = cut_lineage(FT.build_features(readings_events(spark, sf)), "importance-features")
    rows = feats.select("city", "time", *SCORED, "target_aqi_24h")

    def score(df):
        s = sum((F.lit(w) * F.col(c) for c, w in SCORED.items()), F.lit(0.0))
        return df.withColumn("y_pred", F.when(s.isNotNull(), F.greatest(s, F.lit(0.0))))

    return stable(permutation_importance(rows, score, list(SCORED), "target_aqi_24h"), ["rmse", "rmse_permuted", "importance"])


PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)


@register("sketch_quantiles",
          f"WITH r AS (SELECT city, pm2_5 AS v FROM ({RAW}) r WHERE pm2_5 IS NOT NULL AND "
          f"date_trunc('week', time) > (SELECT min(date_trunc('week', time)) FROM ({RAW}) s)) "
          f"SELECT city, CAST(p AS DOUBLE) AS p, count(*) AS n, min(v) AS min, max(v) AS max, TRUE AS within "
          f"FROM r, (SELECT unnest([{', '.join(map(str, PROBS))}]) AS p) GROUP BY city, p")
def q_sketch_quantiles(spark, sf):
    """A4 on a continuous column: quantiles of all weeks but the first from stored sketches; ``within`` says whether the true
    rank of the sketch's value, counted over the readings, is within the stated error of the asked one."""
    raw = raw_events(spark, sf)
    table = cut_lineage(SK.quantile_sketches(raw, "pm2_5", period="week"), "sketches")
    first = table.agg(F.date_add(F.min(SK.PERIOD), 7)).first()[0]
    got = SK.merged(table, first=first).select("city", "n", "min", "max", F.inline(F.array(
        *[F.struct(F.lit(p).alias("p"), SK.quantile(p).alias("q")) for p in PROBS])))
    rows = raw.filter((F.to_date(F.date_trunc("week", "time")) >= F.lit(first)) & F.col("pm2_5").isNotNull()).select(F.col("city").alias("c"), "pm2_5")
    ranks = got.join(rows, F.col("city").eqNullSafe(F.col("c"))).groupBy("city", "p", "n", "min", "max").agg(
        F.avg((F.col("pm2_5") < F.col("q")).cast("int")).alias("lo"), F.avg((F.col("pm2_5") <= F.col("q")).cast("int")).alias("hi"))
    within = (F.col("lo") - SK.RANK_ERROR <= F.col("p")) & (F.col("p") <= F.col("hi") + SK.RANK_ERROR)
    return ranks.select("city", "p", "n", "min", "max", within.alias("within"))
