"""Benchmark: headline jobs on the many-series fixture (one series per supplier, one row per ship day).

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Every query is forced to
completion with the ``noop`` sink (full computation, nothing collected). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from pyspark.sql import functions as F

    from smogline.ml.models import persistence_metrics
    from smogline.operators import aggregates as AG
    from smogline.operators.select import latest_row, tail_n
    from smogline.plans import features as FT
    from smogline.session import cut_lineage, get_spark
    from smogline.sources.adapter import raw_lineitem, readings_events, readings_hot_series, readings_lineitem
    from smogline.tables import keyed as K

    spark = get_spark(f"local[{cpus}]", app="smogline-bench", shuffle_partitions=max(8, cpus * 2),
                      extra={"spark.driver.memory": "16g"})

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)

    # backfill job: readings with the index, landed once as a table (what the feature job reads)
    holder = {}

    def land_readings():
        holder["r"] = cut_lineage(readings_lineitem(spark, sf_dir), "bench-readings")
    timed("aqi_index_store", land_readings)
    readings = holder["r"]
    timed("features_full", lambda: run(FT.build_features(readings, drop_incomplete=True)))
    feats_holder = {}

    def store_features():
        feats_holder["f"] = cut_lineage(FT.build_features(readings, drop_incomplete=True), "bench-features")
    timed("features_store", store_features)
    feats = feats_holder["f"]
    timed("training_matrix_24h", lambda: run(FT.training_matrix(feats, "target_aqi_24h")))
    timed("persistence_metrics", lambda: persistence_metrics(feats).collect())
    timed("box_stats", lambda: run(AG.box_stats(readings)))
    timed("latest_and_tail", lambda: (run(latest_row(readings)), run(tail_n(readings, 49))))

    def upsert():
        raw = raw_lineitem(spark, sf_dir)
        both = K.union_by_name(K.tag_batch(raw, 0), K.tag_batch(raw.withColumn("pm2_5", F.col("pm2_5") + 1.0), 1))
        run(K.retain(K.last_wins(both)))
    timed("upsert_retention", upsert)
    timed("events_features", lambda: run(FT.build_features(readings_events(spark, sf_dir), drop_incomplete=True)))
    # one key holding every row (the skew case): chunked windows spread it over many tasks
    hot = cut_lineage(readings_hot_series(spark, sf_dir), "bench-hot")
    timed("hot_series_features", lambda: run(FT.build_features(hot, drop_incomplete=True)))
    timed("hot_series_training_24h", lambda: run(FT.training_matrix(
        cut_lineage(FT.build_features(hot, drop_incomplete=True), "bench-hot-features"), "target_aqi_24h")))

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir).replace("sf", ""), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
