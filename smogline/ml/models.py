"""Models per forecast horizon (M1-M11), on MLlib.

For each horizon: label filter and training windows (``training_matrix``), chronological 80/20 split,
a pipeline of ``StringIndexer`` (city, season) -> ``Imputer`` (+ is-missing flags) ->
``VectorAssembler`` -> regressor on ``target_delta``; the forecast is max(aqi + delta, 0).
Fitting and scoring are distributed MLlib jobs; nothing is collected except the small metric rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (Imputer, OneHotEncoder, SQLTransformer, StringIndexer, TargetEncoder,
                                VectorAssembler)
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.derived import forecast_from_delta
from ..operators.aggregates import prediction_metrics, select_best
from ..operators.select import latest_row
from ..operators.split import chrono_split
from ..plans.features import training_features
from ..session import cut_lineage
from ..schemas import CATEGORICAL_COLUMNS, MODEL_BASE_COLUMNS, MODEL_EXTRA_COLUMNS, TARGETS, horizon_label

# Reference settings of the boosted-tree model (500 trees, rate 0.03, depth 6, column share 0.8,
# seed 42). The leaf-count limit has no MLlib counterpart; row subsampling is left at 1.0.
GBT_PARAMS = dict(maxIter=500, stepSize=0.03, maxDepth=6, featureSubsetStrategy="0.8", seed=42,
                  subsamplingRate=1.0, maxBins=64, cacheNodeIds=True)
RIDGE_PARAMS = dict(regParam=1.0, elasticNetParam=0.0, maxIter=100)
FOREST_PARAMS = dict(numTrees=100, maxDepth=8, featureSubsetStrategy="onethird", seed=42)

MODELS = {
    "gbt": lambda **kw: GBTRegressor(**{**GBT_PARAMS, **kw}),
    "ridge": lambda **kw: LinearRegression(**{**RIDGE_PARAMS, **kw}),
    "forest": lambda **kw: RandomForestRegressor(**{**FOREST_PARAMS, **kw}),
}


@dataclass
class HorizonFit:
    target: str
    model_name: str
    model: PipelineModel
    features: list[str]
    metrics: DataFrame
    test_predictions: DataFrame
    dropped: list[str] = field(default_factory=list)


def feature_columns(df: DataFrame) -> list[str]:
    base = [c for c in MODEL_BASE_COLUMNS if c in df.columns]
    return base + [c for c in MODEL_EXTRA_COLUMNS if c in df.columns]


def _null_profile(df: DataFrame, cols: list[str]) -> dict[str, tuple[int, int]]:
    """(non-null count, total) per column, from one aggregate."""
    aggs = [F.count(F.col(c)).alias(c) for c in cols] + [F.count(F.lit(1)).alias("__n")]
    row = df.agg(*aggs).first()
    return {c: (row[c], row["__n"]) for c in cols}


def build_pipeline(train: DataFrame, model_name: str = "gbt", label: str = "target_delta", **params):
    """M1 + M2 + regressor. Returns (pipeline, numeric feature names used, all-null columns dropped)."""
    cols = feature_columns(train)
    cats = [c for c in CATEGORICAL_COLUMNS if c in cols]
    nums = [c for c in cols if c not in cats]
    numeric_types = (T.NumericType,)
    nums = [c for c in nums if isinstance(train.schema[c].dataType, numeric_types)]
    prof = _null_profile(train, nums)
    dropped = [c for c, (nn, n) in prof.items() if nn == 0]
    nums = [c for c in nums if c not in dropped]
    with_nulls = [c for c, (nn, n) in prof.items() if 0 < nn < n]
    # casts and missing flags are a stage, so that a saved model scores plain feature rows
    stages = [SQLTransformer(statement="SELECT *, " + ", ".join(
        [f"CAST(`{c}` AS DOUBLE) AS `{c}_num`" for c in nums]
        + [f"CAST(`{c}` IS NULL AS DOUBLE) AS `{c}_missing`" for c in with_nulls]) + " FROM __THIS__")]
    stages += [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep") for c in cats]
    # any number of categories: trees see the mean label of a category, linear models its indicator
    if model_name == "ridge":
        stages.append(OneHotEncoder(inputCols=[f"{c}_idx" for c in cats], outputCols=[f"{c}_enc" for c in cats],
                                    handleInvalid="keep"))
    else:
        stages.append(TargetEncoder(inputCols=[f"{c}_idx" for c in cats], outputCols=[f"{c}_enc" for c in cats],
                                    labelCol=label, targetType="continuous", smoothing=10.0, handleInvalid="keep"))
        # the encoded columns are numbers: without the index's category metadata trees split them as such
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(
            f"{c}_enc + 0D AS {c}_mean" for c in cats) + " FROM __THIS__"))
    imputed = [f"{c}_imp" for c in nums]
    stages.append(Imputer(inputCols=[f"{c}_num" for c in nums], outputCols=imputed, strategy="mean"))
    inputs = [f"{c}_{'enc' if model_name == 'ridge' else 'mean'}" for c in cats] + imputed + [f"{c}_missing" for c in with_nulls]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    reg = MODELS[model_name](**params)
    reg.setFeaturesCol("features").setLabelCol(label).setPredictionCol("pred_delta")
    stages.append(reg)
    names = cats + nums + [f"{c}_missing" for c in with_nulls]
    return Pipeline(stages=stages), names, dropped


def horizon_matrix(features: DataFrame, target: str, fraction: float = 0.8) -> DataFrame:
    """Training matrix of one horizon with the split flag, written once: indexers, imputer, fit and scoring of every
    model read it."""
    return cut_lineage(chrono_split(training_features(features, target), fraction), f"matrix-{target}")


def fit_horizon(features: DataFrame, target: str, model_name: str = "gbt", fraction: float = 0.8,
                model_path: str | None = None, matrix: DataFrame | None = None, **params) -> HorizonFit:
    """One horizon: training matrix (``matrix`` if it is there already), split, fit on train, metrics on test (M3/M4,
    L4, A5, M7)."""
    split = horizon_matrix(features, target, fraction) if matrix is None else matrix
    # a label needs the current index too (delta = target - aqi); rows without it cannot be fitted
    train = split.filter(F.col("is_train") & F.col("target_delta").isNotNull())
    test = split.filter(~F.col("is_train"))
    pipe, names, dropped = build_pipeline(train, model_name, **params)
    model = pipe.fit(train)
    if model_path:
        model.write().overwrite().save(model_path)
    pred = model.transform(test)
    pred = pred.select("city", "time", "aqi", F.col(target).alias("y_true"),
                       forecast_from_delta("aqi", "pred_delta").alias("y_pred"))
    pred = pred.withColumn("horizon", F.lit(horizon_label(target))).withColumn("model", F.lit(model_name))
    metrics = prediction_metrics(pred)
    return HorizonFit(target, model_name, model, names, metrics, pred, dropped)


def persistence_predictions(features: DataFrame, targets=TARGETS, fraction: float = 0.8) -> DataFrame:
    """M5: forecast = current aqi on each horizon's test rows (label filter, then split), all horizons
    from one scan: rows are fanned out per horizon and split per horizon in one pass."""
    per_h = F.array(*[F.struct(F.lit(horizon_label(t)).alias("horizon"), F.col(t).alias("y_true")) for t in targets])
    lab = (features.select("city", "time", "aqi", F.inline(per_h))
           .filter(F.col("y_true").isNotNull()))
    test = chrono_split(lab, fraction, group=["horizon"]).filter(~F.col("is_train"))
    return test.select("city", "time", "aqi", "y_true", forecast_from_delta("aqi", F.lit(0.0)).alias("y_pred"),
                       "horizon", F.lit("persistence").alias("model"))


def persistence_metrics(features: DataFrame, targets=TARGETS, fraction: float = 0.8) -> DataFrame:
    return prediction_metrics(persistence_predictions(features, targets, fraction))


def feature_importance(fit: HorizonFit) -> DataFrame:
    """M8: importance per input feature of a tree model, joined to the feature names."""
    reg = fit.model.stages[-1]
    if not hasattr(reg, "featureImportances"):
        raise ValueError(f"{fit.model_name} has no feature importances")
    imp = reg.featureImportances.toArray().tolist()
    spark = fit.metrics.sparkSession
    rows = [(horizon_label(fit.target), fit.model_name, n, float(v)) for n, v in zip(fit.features, imp)]
    return spark.createDataFrame(rows, "horizon string, model string, feature string, importance double")


def load_model(path: str) -> PipelineModel:
    """M7: absent path -> error (the API's 503)."""
    return PipelineModel.load(path)


def scoring_rows(features: DataFrame, key: str = "city") -> DataFrame:
    """Latest row per city with the training-time columns (W6-W10 need up to 72 earlier rows)."""
    tf = training_features(features.withColumn("_all", F.lit(1)), "_all").drop("_all", "target_delta")
    return latest_row(tf, key)


def saved_models(metrics: DataFrame, targets=TARGETS) -> dict[str, PipelineModel]:
    """The best saved model of every horizon that has one, loaded by its path in the metrics table."""
    saved = metrics.filter(F.col("path").isNotNull())
    best = select_best(saved).select("horizon", "model").join(saved, ["horizon", "model"])
    path = {r["horizon"]: r["path"] for r in best.select("horizon", "path").collect()}  # one row a horizon
    return {t: load_model(path[horizon_label(t)]) for t in targets if horizon_label(t) in path}


def batch_forecast(features: DataFrame, fits: dict[str, HorizonFit | PipelineModel]) -> DataFrame:
    """M9: every city x horizon from its latest row; long table (city, time, horizon, forecast). ``fits`` has
    the fit or the loaded model of each target."""
    rows = scoring_rows(features)
    out = None
    for target, fit in fits.items():
        p = getattr(fit, "model", fit).transform(rows).select(
            "city", "time", F.lit(horizon_label(target)).alias("horizon"),
            forecast_from_delta("aqi", "pred_delta").alias("forecast"))
        out = p if out is None else out.unionByName(p)
    return out


def model_listing(metrics: DataFrame) -> DataFrame:
    """Horizon -> model and artifact path."""
    return metrics.select("horizon", "model", "path").orderBy("horizon", "model")


__all__ = ["fit_horizon", "horizon_matrix", "persistence_metrics", "feature_importance", "batch_forecast", "select_best",
           "load_model", "saved_models", "model_listing", "MODELS", "GBT_PARAMS"]
