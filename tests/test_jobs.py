"""End to end: landed archive -> backfill -> features -> keyed store -> training -> forecast."""

from pyspark.sql import functions as F

from smogline.ml import models as M
from smogline.plans import fixtures as FX
from smogline.plans import jobs as J
from smogline.schemas import TARGETS
from smogline.session import scratch_path
from smogline.sources.adapter import raw_events
from smogline.tables.keyed import KeyedTable

SF = "/root/testdata/sf0.001"


def test_pipeline_end_to_end(spark):
    raw = raw_events(spark, SF)
    wpath, apath = FX.land_archive(raw)
    root = scratch_path(spark, "t-jobs")
    readings = J.backfill_job(spark, wpath, apath, f"{root}/raw")
    assert readings.count() == raw.count()
    assert readings.filter(F.col("aqi").isNull()).count() == 0  # history rule: never null
    seq = J.feature_job(spark, f"{root}/raw/readings", f"{root}/store")
    assert seq == 0
    store = KeyedTable(spark, f"{root}/store").current()
    assert store.count() > 0
    res = J.training_job(spark, f"{root}/models", store_path=f"{root}/store", models=("gbt", "ridge"),
                         gbt={"maxIter": 2})
    m = res.metrics.collect()
    assert {r["model"] for r in m} == {"gbt", "ridge", "persistence"}
    assert {r["horizon"] for r in m} == {"24h", "48h", "72h"}
    assert res.best.count() == 3
    fc, alerts = J.forecast_job(spark, store, {k: v for k, v in res.fits.items() if k[0] == "gbt"}, f"{root}/out")
    n_cities = store.select("city").distinct().count()
    assert fc.count() == 3 * n_cities and alerts.count() == n_cities
    # the saved models score plain rows after a reload, with the same forecasts as in memory
    best = {r["horizon"]: r["model"] for r in M.select_best(res.metrics.filter("path is not null")).collect()}
    fits = {t: res.fits[(best[J.horizon_label(t)], t)] for t in TARGETS}
    inside = {(r["city"], r["horizon"]): r["forecast"] for r in M.batch_forecast(store, fits).collect()}
    saved, _ = J.forecast_saved_job(spark, f"{root}/models", f"{root}/store", f"{root}/saved")
    assert {(r["city"], r["horizon"]): r["forecast"] for r in saved.collect()} == inside
