"""The pipeline's jobs, in run order: backfill, feature build + store, hourly live update, daily
training, forecast. Each is a function over paths in the shared storage, and ``main`` exposes them as
``python -m smogline.plans.jobs <job> ...``.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aqi import alert_level
from ..ml import models as M
from ..operators.aggregates import select_best
from ..operators.select import latest_row
from ..schemas import FEATURES_SCHEMA, READINGS_SCHEMA, TARGETS, horizon_label
from ..sources import ingest
from ..operators.relabel import Relabelling
from ..tables.buckets import BucketTable, by_time
from ..tables.keyed import KeyedTable, last_wins, read_with_fallback
from ..tables.outbox import Outbox, folder_sink
from .features import build_features


def backfill_job(spark: SparkSession, weather_path: str, air_path: str, out_root: str) -> DataFrame:
    """Landed archive payloads -> readings (history index rule), written combined and per city;
    malformed records and rows without key/time go to ``quarantine``."""
    readings, rejected = ingest.read_archive(spark, weather_path, air_path, missing="zero")
    ingest.write_table(readings, f"{out_root}/readings")
    ingest.write_per_city(spark.read.parquet(f"{out_root}/readings"), f"{out_root}/readings_by_city")
    rejected.write.mode("overwrite").parquet(f"{out_root}/quarantine")
    return spark.read.parquet(f"{out_root}/readings")


def feature_job(spark: SparkSession, readings_path: str, store_path: str, batch_seq: int | None = None,
                sinks: dict | None = None, required=()) -> int:
    """Readings -> complete-row features -> one insert into the keyed feature table, published to ``sinks``.

    A missing input is an empty table; rows without key or time go to ``quarantine/batch_seq=<n>`` of the store; NaN becomes null;
    of rows with one key the one with the greatest content hash stays, so that windows see each hour once."""
    readings = ingest.read_or_empty(spark, readings_path, READINGS_SCHEMA)
    valid, bad = ingest.quarantine_split(readings)
    valid = ingest.normalise_nan(valid)
    unique = last_wins(valid.withColumn("_tie", F.xxhash64(*valid.columns)), order=("_tie",))
    store = KeyedTable(spark, store_path)
    seq = store.insert(build_features(unique, drop_incomplete=True), batch_seq)
    bad.write.mode("overwrite").parquet(f"{store_path}/quarantine/batch_seq={seq}")
    if sinks:
        box = Outbox(spark, f"{store_path}/outbox")
        rows = store.log()
        if rows is not None:
            box.enqueue(rows.filter(F.col("batch_seq") == seq).select(*FEATURES_SCHEMA.fieldNames()), seq, sinks, required)
        box.drain(sinks)
    return seq


def relabel_job(spark: SparkSession, readings_path: str, root: str, batch: int) -> list[int]:
    """Late or corrected readings (and live rows whose targets are due) -> the readings and features under ``root`` brought up
    to date where they reach; batch 0 is the first build. The features are what ``training_job`` reads next. Returns the
    time buckets that were opened."""
    readings = ingest.read_or_empty(spark, readings_path, READINGS_SCHEMA)
    valid, bad = ingest.quarantine_split(readings)
    bad.write.mode("overwrite").parquet(f"{root}/quarantine/batch={batch}")
    job = Relabelling(BucketTable(spark, f"{root}/readings", by_time()), BucketTable(spark, f"{root}/features", by_time()))
    rows = ingest.normalise_nan(valid)
    if batch == 0:
        job.load(rows)
        return job.readings.buckets()
    return job.update(rows, batch)


def live_job(spark: SparkSession, landing: str, state_root: str, checkpoint: str,
             history_path: str | None = None, max_files: int | None = None, sinks: dict | None = None, required=()):
    """Hourly run as a stream: new landed readings -> buffer upsert -> live features -> sinks (``availableNow``).

    What an earlier run could not deliver is offered first."""
    from ..streaming.live import LiveJob, readings_stream
    history = ingest.read_or_empty(spark, history_path, READINGS_SCHEMA) if history_path else None
    job = LiveJob(spark, state_root, history=history, sinks=sinks, required=required)
    job.publish()
    job.run(readings_stream(spark, landing, max_files=max_files), checkpoint)
    return job


@dataclass
class TrainingResult:
    metrics: DataFrame
    best: DataFrame
    fits: dict


def training_job(spark: SparkSession, model_root: str, store_path: str | None = None,
                 batch_path: str | None = None, live_path: str | None = None,
                 models=("gbt",), relabelled: str | None = None, **params) -> TrainingResult:
    """Feature table (the features of ``relabel_job`` under ``relabelled``, else the store, else batch table + live rows, last
    wins) -> one pipeline per horizon and model, saved under ``model_root``; metrics (with the persistence baseline) written next to them."""
    if relabelled:
        feats = BucketTable(spark, f"{relabelled}/features", by_time()).read()
    elif store_path:
        feats = KeyedTable(spark, store_path).current() if KeyedTable(spark, store_path).exists() else None
    else:
        feats = None
    if feats is None:
        batch = spark.read.schema(FEATURES_SCHEMA).parquet(batch_path)
        live = spark.read.schema(FEATURES_SCHEMA).parquet(live_path) if live_path else None
        feats = read_with_fallback(spark, None, batch, live)
    feats = feats.select(*FEATURES_SCHEMA.fieldNames())
    rows, fits = [], {}
    for name in models:
        for target in TARGETS:
            path = f"{model_root}/{target}_{name}"
            fit = M.fit_horizon(feats, target, name, model_path=path, **params.get(name, {}))
            fits[(name, target)] = fit
            rows.append(fit.metrics.withColumn("path", F.lit(path)))
    metrics = M.persistence_metrics(feats).withColumn("path", F.lit(None).cast("string"))
    for r in rows:
        metrics = metrics.unionByName(r)
    metrics.write.mode("overwrite").parquet(f"{model_root}/metrics")
    metrics = spark.read.parquet(f"{model_root}/metrics")
    return TrainingResult(metrics, select_best(metrics), fits)


def forecast_job(spark: SparkSession, features: DataFrame, fits: dict, out_root: str,
                 best: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Batch forecast per city x horizon from the latest row, and the alert report. ``best`` (``select_best``)
    names the model of each horizon; where it names none of the fits, the first fitted model is used."""
    chosen = {r["horizon"]: r["model"] for r in best.collect()} if best is not None else {}  # one row a horizon
    by_target = {}
    for (name, t), f in fits.items():
        if t not in by_target or name == chosen.get(horizon_label(t)):
            by_target[t] = f
    fc = M.batch_forecast(features, by_target)
    fc.write.mode("overwrite").parquet(f"{out_root}/forecast")
    a = alert_level("aqi")
    alerts = latest_row(features.select("city", "time", "aqi")).select(
        "city", "time", "aqi", a["level"].alias("level"), a["colour"].alias("colour"))
    alerts.write.mode("overwrite").parquet(f"{out_root}/alerts")
    return spark.read.parquet(f"{out_root}/forecast"), spark.read.parquet(f"{out_root}/alerts")


def forecast_saved_job(spark: SparkSession, model_root: str, features_path: str, out_root: str):
    """``forecast_job`` from disk: the best saved model of each horizon by the metrics table of
    ``training_job``, over a keyed feature table or a plain one (e.g. the live features)."""
    features = read_with_fallback(spark, features_path, spark.createDataFrame([], FEATURES_SCHEMA), None)
    models = M.saved_models(spark.read.parquet(f"{model_root}/metrics"))
    if not models:
        raise FileNotFoundError(f"no saved model in {model_root}/metrics")
    return forecast_job(spark, features, {("saved", t): m for t, m in models.items()}, out_root)


def main(argv=None) -> None:
    from ..session import get_spark
    p = argparse.ArgumentParser(prog="smogline.plans.jobs")
    sub = p.add_subparsers(dest="job", required=True)
    b = sub.add_parser("backfill"); b.add_argument("weather"); b.add_argument("air"); b.add_argument("out")
    f = sub.add_parser("features"); f.add_argument("readings"); f.add_argument("store"); f.add_argument("--publish")
    rl = sub.add_parser("relabel"); rl.add_argument("readings"); rl.add_argument("root"); rl.add_argument("batch", type=int)
    lv = sub.add_parser("live"); lv.add_argument("landing"); lv.add_argument("state"); lv.add_argument("checkpoint")
    lv.add_argument("--history"); lv.add_argument("--publish")
    t = sub.add_parser("train"); t.add_argument("models_dir"); t.add_argument("--store"); t.add_argument("--batch")
    t.add_argument("--live"); t.add_argument("--models", default="gbt")
    fc = sub.add_parser("forecast"); fc.add_argument("models_dir"); fc.add_argument("features"); fc.add_argument("out")
    t.add_argument("--relabelled")
    a = p.parse_args(argv)
    spark = get_spark()
    sinks = {"folder": folder_sink(a.publish)} if getattr(a, "publish", None) else None
    if a.job == "backfill":
        print(backfill_job(spark, a.weather, a.air, a.out).count())
    elif a.job == "features":
        print(feature_job(spark, a.readings, a.store, sinks=sinks))
    elif a.job == "live":
        live_job(spark, a.landing, a.state, a.checkpoint, a.history, sinks=sinks)
    elif a.job == "relabel":
        print(relabel_job(spark, a.readings, a.root, a.batch))
    elif a.job == "forecast":
        print(forecast_saved_job(spark, a.models_dir, a.features, a.out)[0].count())
    elif a.job == "train":
        res = training_job(spark, a.models_dir, a.store, a.batch, a.live, models=tuple(a.models.split(",")),
                           relabelled=a.relabelled)
        for r in res.metrics.collect():
            print(json.dumps({k: (v if not hasattr(v, "isoformat") else v.isoformat()) for k, v in r.asDict().items()}))


if __name__ == "__main__":
    main()


__all__ = ["backfill_job", "feature_job", "live_job", "relabel_job", "training_job", "forecast_job",
           "forecast_saved_job", "horizon_label"]
