"""Closed-form ridge: fits against numpy, merging, taking out, rolling up, and defined results."""

import math

import numpy as np
import pandas as pd
import pytest

from smogline.ml import ridge

X = [f"x{i}" for i in range(8)]


def _plain(rows, alpha):
    x, y = rows[X].to_numpy(float), rows["y"].to_numpy(float)
    xc, yc = x - x.mean(0), y - y.mean()
    b = np.linalg.solve(xc.T @ xc + alpha * np.eye(len(X)), xc.T @ yc)
    b0 = y.mean() - x.mean(0) @ b
    return b0, b, float(((y - b0 - x @ b) ** 2).sum())


def _same(row, rows, alpha):
    b0, b, sse = _plain(rows, alpha)
    assert row["n"] == len(rows)
    assert row["intercept"] == pytest.approx(b0, rel=1e-6, abs=1e-8)
    assert np.allclose(row["coefficients"], b, rtol=1e-6, atol=1e-8)
    assert row["sse"] == pytest.approx(sse, rel=1e-6, abs=1e-6)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(10, 4, (900, 8)), columns=X)
    pdf["y"] = pdf[X].to_numpy() @ np.arange(8) + 3 + rng.normal(0, 2, 900)
    pdf["city"] = np.where(np.arange(900) % 3 == 0, "hot", np.where(np.arange(900) % 7 == 0, None, "b"))
    pdf["part"] = np.arange(900) % 4
    return pdf.astype({"city": object})


def test_fits_equal_numpy_after_merging_and_taking_out(spark, data):
    df = spark.createDataFrame(data, ", ".join(f"{x} double" for x in X) + ", y double, city string, part long")
    parts = [ridge.moments(df.filter(df.part == p), X, "y", ["city"]) for p in range(4)]
    table = ridge.merge(parts, ["city"])
    for row in ridge.solve(table, X, 1.0, ["city"]).collect():
        own = data[data.city.isna()] if row["city"] is None else data[data.city == row["city"]]
        _same(row, own, 1.0)
    left = ridge.downdate(table, parts[2], ["city"])
    _same(ridge.solve(ridge.merge([left]), X, 2.5).first(), data[data.part != 2], 2.5)
    none = ridge.downdate(table, table, ["city"])
    assert {(r["n"], r["intercept"], r["coefficients"]) for r in ridge.solve(none, X, 1.0, ["city"]).collect()} == {(0, None, None)}

    got = ridge.predict(df, ridge.solve(table, X, 1.0, ["city"]), X, ["city"], "p").toPandas()
    assert len(got) == len(data) and got.p.notna().all()
    for city in ("hot", None):
        own, mine = (v[v.city.isna()] if city is None else v[v.city == city] for v in (data, got))
        b0, b, _ = _plain(own, 1.0)
        assert np.allclose(np.sort(mine.p), np.sort(b0 + own[X].to_numpy() @ b), rtol=1e-6)


def test_missing_values_empty_tables_and_dependent_features(spark, data):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 7.0), (3.0, 6.0, 9.0), (None, 1.0, 1.0), (1.0, math.nan, 1.0),
                                (1.0, 1.0, None)], "a double, b double, y double")
    row = ridge.solve(ridge.moments(df, ["a", "b"], "y"), ["a", "b"], 0.0).first()
    assert row["n"] == 3 and row["sse"] == pytest.approx(0, abs=1e-8)
    assert row["coefficients"] == pytest.approx([0.4, 0.8])          # least norm of a + 2 b = 2
    empty = ridge.moments(df.limit(0), ["a", "b"], "y")
    assert tuple(ridge.solve(empty, ["a", "b"]).first()) == (0, None, None, None)
    assert ridge.solve(ridge.moments(df.limit(0), ["a"], "y", ["b"]), ["a"], 1.0, ["b"]).count() == 0


def test_groups_are_one_partial_aggregate(spark, data):
    df = spark.createDataFrame(data[["x0", "x1", "y", "city"]], "x0 double, x1 double, y double, city string")
    plan = ridge.moments(df, ["x0", "x1"], "y", ["city"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("partial_sum") and "Python" not in plan
