"""Aggregations: counts (A1), distinct cities (A2), max time (A3), box statistics (A4), forecast
metrics (A5) and model selection (M6). All are hash aggregates with map-side partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(df: DataFrame, key: str = "city") -> DataFrame:
    """A1: rows and distinct series."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_cities"))


def distinct_cities(df: DataFrame, key: str = "city") -> DataFrame:
    """A2: sorted distinct series keys."""
    return df.select(key).distinct().orderBy(key)


def max_time(df: DataFrame, time: str = "time") -> DataFrame:
    """A3: global max event time."""
    return df.agg(F.max(time).alias("max_time"))


def box_stats(df: DataFrame, value: str = "aqi", key: str = "city") -> DataFrame:
    """A4: quartiles (linear interpolation), 1.5 IQR fences, whiskers and outliers per series.

    ``percentile`` keeps a value -> count map per group; for an integer index that map has at most a
    few hundred entries whatever the number of rows, and partial maps merge before the shuffle. The
    whiskers need the fences, so a second aggregate runs on the rows joined with the per-series
    quartiles (one row per series)."""
    q = df.groupBy(key).agg(
        F.percentile(F.col(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))
    q = q.select(key, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"),
                 "min", "max", "n")
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")).withColumns({
        "lower_fence": F.col("q1") - F.lit(1.5) * (F.col("q3") - F.col("q1")),
        "upper_fence": F.col("q3") + F.lit(1.5) * (F.col("q3") - F.col("q1")),
    })
    v = F.col(value)
    j = df.select(key, value).join(q.select(key, "lower_fence", "upper_fence"), on=key)
    inside = (v >= F.col("lower_fence")) & (v <= F.col("upper_fence"))
    w = j.groupBy(key).agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count(F.when(v.isNotNull() & ~inside, F.lit(1))).alias("n_outliers"))
    return q.join(w, on=key)


def prediction_metrics(pred: DataFrame, y: str = "y_true", p: str = "y_pred",
                       group=("horizon", "model")) -> DataFrame:
    """A5: MAE, RMSE, R2 per group, in one pass (the total sum of squares is the population variance
    times the count, which Spark merges without cancellation).

    R2 follows the usual convention for a constant truth: 1 if the predictions are exact, else 0."""
    group = list(group)
    err = F.col(p) - F.col(y)
    g = pred.groupBy(*group).agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.sum(err * err).alias("_sse"),
        (F.var_pop(y) * F.count(y)).alias("_sst"),
        F.count(F.lit(1)).alias("n"))
    r2 = (F.when(F.col("_sst") != 0, F.lit(1.0) - F.col("_sse") / F.col("_sst"))
          .when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return g.withColumn("r2", r2).drop("_sse", "_sst")


def select_best(metrics: DataFrame, by: str = "rmse", group: str = "horizon") -> DataFrame:
    """M6: best model per horizon (lowest ``by``; ties broken by model name)."""
    return metrics.groupBy(group).agg(
        F.min_by(F.col("model"), F.struct(F.col(by), F.col("model"))).alias("model"),
        F.min(by).alias(by))
