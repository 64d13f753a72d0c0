"""Short series are shuffled once, shared inputs are read once; rows are built here."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from smogline.operators import sequence as S
from smogline.plans import queries_core, queries_more
from smogline.streaming import live

START = dt.datetime(2024, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def lineitem(spark, tmp_path):
    """Three suppliers (one of them null) of 120 days, two rows on every fifth day, and rows without a date."""
    day = F.col("id") % 120
    li = spark.range(360).select(
        F.when(F.col("id") < 240, (F.col("id") / 120).cast("long")).alias("l_suppkey"),
        F.when(F.col("id") % 50 != 7, F.date_add(F.lit(START.date()), day.cast("int"))).alias("l_shipdate"),
        (F.col("id") * 7 % 50 + 1).cast("double").alias("l_quantity"), (F.col("id") % 11 / 100.0).alias("l_discount"),
        (F.col("id") % 9 / 100.0).alias("l_tax"), (F.col("id") * 31 % 977 + 0.5).alias("l_extendedprice"),
        (F.col("id") % 7).cast("int").alias("l_linenumber"), F.col("id").alias("l_orderkey"))
    again = li.filter(F.col("l_orderkey") % 5 == 0).withColumn("l_quantity", F.col("l_quantity") + 3)
    li.unionByName(again).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_short_lineitem_series_take_one_shuffle(spark, lineitem, monkeypatch):
    got = queries_core.q_features_lineitem(spark, lineitem)
    assert _plan(got).count("Exchange") == 1
    monkeypatch.setattr(queries_core, "DEFAULT_CHUNK_ROWS", 1)      # long series: chunks as before
    want = queries_core.q_features_lineitem(spark, lineitem)
    assert _plan(want).count("Exchange") > 1
    rows = sorted(got.collect(), key=str)
    assert len(rows) > 40 and rows == sorted(want.collect(), key=str)


def test_series_beyond_the_bucket_table_are_not_numbered(spark, monkeypatch):
    rows = [(c, START + dt.timedelta(hours=11 * i) if i != 5 else None, c_i * 100 + i)
            for c_i, c in enumerate(["a", "b", None]) for i in range(90)]
    df = spark.createDataFrame(rows, "city string, time timestamp_ntz, x int")

    def compute(d, w):
        return d.withColumns({"before": F.lag("x", 3).over(w), "after": F.lead("x", 7).over(w)})

    def run(chunk_rows):
        out = S.over_series(df, "city", compute, lookback=3, lookahead=7, chunk_rows=chunk_rows, keep_position=True)
        return out, sorted(out.select("city", "time", "x", "before", "after").collect(), key=str)

    _, want = run(100)
    monkeypatch.setattr(S, "MAX_BUCKET_TABLE_ROWS", 2)
    numbered, plain = run(50)                                       # series of 89 rows, chunks of 50
    short, got = run(100)
    assert "Join" in _plan(numbered) and "Join" not in _plan(short)
    assert len(want) == 267 and got == want and plain == want


def test_live_stream_groups_the_events_once(spark, tmp_path, monkeypatch):
    ev = spark.range(400).select(
        F.col("id").alias("event_id"), (F.lit(START) + F.make_dt_interval(hours=(F.col("id") / 4).cast("int"))).alias("ts"),
        (F.col("id") % 13).alias("user_id"), F.concat(F.lit("t"), (F.col("id") % 2).cast("string")).alias("event_type"),
        (F.col("id") % 17).cast("double").alias("value"), F.concat(F.lit('{"k": '), F.col("id") % 90, F.lit("}")).alias("props"))
    ev.write.parquet(str(tmp_path / "events.parquet"))
    seen = {}

    class Job:
        def __init__(self, spark, root, history=None, **kw):
            seen["history"] = history

        def run(self, *a):
            raise StopIteration

    land = queries_more.FX.land_batches
    monkeypatch.setattr(queries_more.FX, "land_batches", lambda frames, *a, **kw: seen.update(frames=frames) or land(frames[:2], *a, **kw))
    monkeypatch.setattr(live, "LiveJob", Job)
    with pytest.raises(StopIteration):
        queries_more.q_live_stream(spark, str(tmp_path))
    assert len(seen["frames"]) == 24
    assert not any("Aggregate" in _plan(f) for f in [seen["history"], *seen["frames"]])
    assert [f.count() for f in seen["frames"][:2]] == [2, 2] and seen["history"].count() == 2 * 76


def test_model_queries_share_matrices_and_features(spark, tmp_path, monkeypatch):
    from pyspark.ml.regression import LinearRegression

    from smogline.ml import models as M
    ev = spark.range(800).select(
        F.col("id").alias("event_id"), (F.lit(START) + F.make_dt_interval(hours=(F.col("id") / 2).cast("int"))).alias("ts"),
        (F.col("id") % 13).alias("user_id"), F.concat(F.lit("t"), (F.col("id") % 2).cast("string")).alias("event_type"),
        (F.col("id") * 7 % 61).cast("double").alias("value"),
        F.concat(F.lit('{"k": '), F.col("id") * 3 % 70, F.lit("}")).alias("props"))
    ev.write.parquet(str(tmp_path / "events.parquet"))
    calls = {"events": 0, "windows": 0}

    def counted(name, fn):
        def call(*a, **kw):
            calls[name] += 1
            return fn(*a, **kw)
        return call

    monkeypatch.setattr(queries_more, "readings_events", counted("events", queries_more.readings_events))
    monkeypatch.setattr(M, "training_features", counted("windows", M.training_features))
    monkeypatch.setattr(M, "MODELS", {m: lambda **kw: LinearRegression(regParam=1.0) for m in M.MODELS})
    monkeypatch.setattr(queries_more, "_FITS", {})
    monkeypatch.setattr(queries_more, "_INPUTS", {}, raising=False)
    best = queries_more.q_model_select(spark, str(tmp_path)).collect()
    assert sorted(r["horizon"] for r in best) == ["24h", "48h", "72h"]
    listed = queries_more.q_model_listing(spark, str(tmp_path)).collect()
    assert [(r["horizon"], r["model"]) for r in listed] == [(h, m) for h in ("24h", "48h", "72h") for m in ("forest", "gbt", "ridge")]
    assert calls == {"events": 1, "windows": 3}                     # whatever the number of models
    feats = queries_more._model_inputs(spark, str(tmp_path))[0]
    alone = M.fit_horizon(feats, "target_aqi_48h", "ridge").metrics.first()
    shared = queries_more._fits(spark, str(tmp_path), "ridge")["target_aqi_48h"].metrics.first()
    assert (alone["n"], alone["model"]) == (shared["n"], "ridge") and alone["rmse"] == pytest.approx(shared["rmse"], rel=1e-9)
