"""Permutation importance against a plain permutation, and quantile sketches against sorted values."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from smogline.ml import ridge
from smogline.ml.importance import permutation_importance, random_rank, variants
from smogline.operators import sketches as SK


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.arange(600), "a": rng.normal(0, 3, 600), "b": rng.normal(0, 3, 600), "c": rng.normal(0, 3, 600)})
    pdf["y"] = 4 * pdf.a + pdf.b
    return pdf, spark.createDataFrame(pdf)


def _order(ids, seed):
    return sorted(ids, key=lambda i: hashlib.md5(f"{i}|{seed}".encode()).hexdigest())


def test_ranks_and_variants_are_the_plain_permutation(rows):
    pdf, df = rows
    ids = pdf.id.tolist()
    assert [r["id"] for r in random_rank(df, ["id"], 9, "r").orderBy("r").collect()] == _order(ids, 9)
    donor = dict(zip(_order(ids, 42), _order(ids, 43), strict=True))
    got = variants(df, ["a", "b"], ["id"]).toPandas()
    assert len(got) == 3 * len(ids)
    for r in got.itertuples(index=False):
        own, other = pdf.loc[r.id], pdf.loc[donor[r.id]]
        variant = r[list(got.columns).index("_variant")]
        assert r.a == (other.a if variant == "a" else own.a) and r.b == (other.b if variant == "b" else own.b) and r.c == own.c


def test_importance_of_linear_and_tree_models(spark, rows):
    pdf, df = rows
    x = ["a", "b", "c"]
    fits = ridge.solve(ridge.moments(df.withColumn("g", F.lit(1)), x, "y", ["g"]), x, 1e-6, ["g"])
    linear = permutation_importance(df.withColumn("g", F.lit(1)), lambda d: ridge.predict(d, fits, x, ["g"], "y_pred"), x, "y", ["id"])
    tree = Pipeline(stages=[VectorAssembler(inputCols=x, outputCol="v"), DecisionTreeRegressor(
        featuresCol="v", labelCol="y", predictionCol="y_pred", maxDepth=6)]).fit(df)
    for out in (linear, permutation_importance(df, tree.transform, x, "y", ["id"])):
        by = {r["feature"]: r for r in out.collect()}
        assert all(r["n"] == 600 for r in by.values())
        assert by["a"]["importance"] > 2 * by["b"]["importance"] > 4 * abs(by["c"]["importance"])
    assert {r["feature"]: r["importance"] for r in linear.collect()}["c"] == pytest.approx(0, abs=1e-3)
    a = pdf.set_index("id").a
    dealt = a.loc[[i for _, i in sorted(zip(_order(pdf.id, 42), _order(pdf.id, 43), strict=True))]].to_numpy()
    want = math.sqrt(np.mean((4 * (dealt - a.to_numpy())) ** 2))
    assert {r["feature"]: r["rmse_permuted"] for r in linear.collect()}["a"] == pytest.approx(want, rel=1e-4)


def test_importance_of_nulls_and_empty_tables(rows):
    _, df = rows
    score = lambda d: d.withColumn("y_pred", F.col("a") * 4)
    some = df.withColumn("y", F.when(F.col("id") % 2 == 0, F.col("y")))
    assert {r["n"] for r in permutation_importance(some, score, ["a", "b"], "y", ["id"]).collect()} == {300}
    none = permutation_importance(df.limit(0), score, ["a"], "y", ["id"]).collect()
    assert [tuple(r) for r in none] == [("a", None, None, None, 0)]
    with pytest.raises(ValueError):
        permutation_importance(df, score, ["id"], "y", ["id"])


def test_sketches_merge_within_the_rank_error(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"city": np.where(np.arange(60_000) % 3 > 0, "hot", "b"), "v": rng.lognormal(2, 1, 60_000),
                        "time": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(60_000) % 5000, unit="h")})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame(
        [("b", math.nan, None), ("b", None, None), ("void", None, None)], "city string, v double, time timestamp")
        .withColumn("time", F.lit("2024-02-03").cast("timestamp")))
    table = SK.quantile_sketches(df.repartition(7), "v")
    got = SK.merged(table, first="2024-02-01", last="2024-04-01")
    month = pdf.time.dt.to_period("M").astype(str)
    for r in got.select("city", "n", "min", "max", *[SK.quantile(p).alias(str(p)) for p in (0.01, 0.5, 0.9)]).collect():
        own = np.sort(pdf[(pdf.city == r["city"]) & (month >= "2024-02") & (month <= "2024-04")].v.to_numpy())
        assert r["n"] == len(own)
        if not len(own):
            assert r["city"] == "void" and r["min"] is None and r["0.5"] is None
            continue
        assert (r["min"], r["max"]) == (own[0], own[-1])
        for p in (0.01, 0.5, 0.9):
            assert abs(np.searchsorted(own, r[str(p)]) / len(own) - p) <= SK.RANK_ERROR
    box = {r["city"]: r for r in SK.sketched_box_stats(got).collect()}
    assert box["hot"]["q1"] < box["hot"]["median"] < box["hot"]["q3"] < box["hot"]["upper_fence"]
    assert SK.merged(table.limit(0)).count() == 0
