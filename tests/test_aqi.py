"""P1/P2/P13 against literal values: bucket edges, gaps, null, NaN, negative, above top, .5 ties."""

import math

import pytest
from pyspark.sql import functions as F

from smogline.functions import aqi as AQ


# Concentrations and the sub-indices that the published tables give for them, worked out by hand
# (bucket ends are the tables' own; between buckets and below zero the index is 0, above the top it is 500).
PM25_PAIRS = [(None, None), (float("nan"), 0), (-1.0, 0), (0.0, 0), (3.0, 12), (6.0, 25), (12.0, 50), (12.05, 0), (12.1, 51),
              (23.75, 76), (35.4, 100), (35.45, 0), (35.5, 101), (55.4, 150), (55.45, 0), (55.5, 151), (150.4, 200),
              (150.45, 0), (150.5, 201), (250.4, 300), (250.5, 301), (350.4, 400), (350.5, 401), (500.4, 500),
              (500.5, 500), (1e9, 500)]
PM10_PAIRS = [(None, None), (float("nan"), 0), (-0.5, 0), (0.0, 0), (27.0, 25), (54.0, 50), (54.5, 0), (55.0, 51), (154.0, 100),
              (154.5, 0), (155.0, 101), (254.0, 150), (255.0, 151), (354.0, 200), (355.0, 201), (424.0, 300), (425.0, 301),
              (504.0, 400), (505.0, 401), (604.0, 500), (605.0, 500)]


def edge_values(table):
    vals = [None, float("nan"), -1.0, -0.0, 0.0, 1e9]
    for lo, hi, _, _ in table:
        vals += [float(lo), float(hi), lo + 0.05, hi + 0.05, hi + 0.5, (lo + hi) / 2, hi - 1e-9]
    return vals


@pytest.mark.parametrize("name,pairs", [("pm25", PM25_PAIRS), ("pm10", PM10_PAIRS)])
def test_sub_index_pairs(spark, name, pairs):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(pairs)], "i int, c double")
    got = {r["i"]: r["s"] for r in df.select("i", AQ.sub_index("c", name).alias("s")).collect()}
    assert [got[i] for i in range(len(pairs))] == [s for _, s in pairs]


def test_half_even_ties(spark):
    """3.24 x 50 / 54 = 3 exactly; a quarter and three quarters of a 50-step give ties at .5."""
    # (concentration, index before rounding, rounded half to even); slope 50 / 54 of the first PM10 bucket
    ties = [(0.54, 0), (1.62, 2), (2.7, 2), (3.78, 4), (4.86, 4)]
    df = spark.createDataFrame([(c,) for c, _ in ties], "c double")
    got = [r["s"] for r in df.select("c", AQ.sub_index("c", "pm10").alias("s")).collect()]
    for (c, even), s in zip(ties, got):
        exact = 50 / 54 * c
        assert s == (even if exact % 1 == 0.5 else math.floor(exact + 0.5)), (c, s)


def test_aqi_missing_modes(spark):
    df = spark.createDataFrame([(None, None), (10.0, None), (None, 60.0), (float("nan"), 30.0), (600.0, 1.0)],
                               "a double, b double")
    live = [r[0] for r in df.select(AQ.aqi("a", "b", missing="skip")).collect()]
    hist = [r[0] for r in df.select(AQ.aqi("a", "b", missing="zero")).collect()]
    assert live == [None, 42, 53, 28, 500]
    assert hist == [0, live[1], live[2], 28, 500]


def test_range_join_equals_when_chain(spark, readings):
    from smogline.operators.joins import aqi_by_range_join
    raw = readings.drop("aqi")
    a = readings.select("city", "time", "aqi")
    b = aqi_by_range_join(raw).select("city", "time", F.col("aqi").alias("aqi2"))
    bad = a.join(b, ["city", "time"]).filter(~F.col("aqi").eqNullSafe(F.col("aqi2"))).count()
    assert bad == 0


def test_alert_levels(spark):
    df = spark.createDataFrame([(None,), (0,), (50,), (51,), (101,), (151,), (201,), (301,)], "a int")
    got = [r[0] for r in df.select(AQ.alert_level("a")["level"]).collect()]
    assert got == ["Unknown", "Good", "Good", "Moderate", "Unhealthy for Sensitive Groups",
                   "Unhealthy - Orange Alert", "Very Unhealthy - Red Alert", "Hazardous"]


@pytest.mark.parametrize("gap", ["zero", "truncate"])
def test_column_form_equals_sql_form(spark, gap):
    vals = edge_values(AQ.PM25_BREAKPOINTS) + edge_values(AQ.PM10_BREAKPOINTS)
    df = spark.createDataFrame([(i, v, v) for i, v in enumerate(vals)], "i int, a double, b double")
    out = df.select(
        "i",
        AQ.aqi("a", "b", missing="zero", gap=gap).alias("sql_form"),
        AQ.aqi(F.col("a"), F.col("b"), missing="zero", gap=gap).alias("col_form"),
        AQ.sub_index("a", "pm25", gap).alias("s1"), AQ.sub_index(F.col("a"), "pm25", gap).alias("s2"))
    bad = out.filter(~F.col("sql_form").eqNullSafe(F.col("col_form")) | ~F.col("s1").eqNullSafe(F.col("s2")))
    assert bad.count() == 0
