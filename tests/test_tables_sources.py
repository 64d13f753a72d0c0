"""Round trips, last-wins and split properties."""

import datetime as dt

from pyspark.sql import functions as F

from smogline.operators import select as SEL
from smogline.operators.split import chrono_split
from smogline.plans import fixtures as FX
from smogline.schemas import READINGS_SCHEMA
from smogline.session import scratch_path
from smogline.sources import ingest
from smogline.sources.adapter import raw_events
from smogline.tables import keyed as K

SF = "/root/testdata/sf0.001"


def _rows(df, cols=("city", "time")):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_last_wins_orders_by_batch_then_row(spark):
    t = dt.datetime(2024, 1, 1, 0)
    a = spark.createDataFrame([("x", t, 1.0), ("x", t, 2.0)], "city string, time timestamp_ntz, v double")
    b = spark.createDataFrame([("x", t, 3.0), ("y", t, 4.0)], "city string, time timestamp_ntz, v double")
    both = K.union_by_name(K.tag_batch(a.coalesce(1), 0), K.tag_batch(b.coalesce(1), 1))
    got = {r["city"]: r["v"] for r in K.last_wins(both).collect()}
    assert got == {"x": 3.0, "y": 4.0}
    only_a = {r["city"]: r["v"] for r in K.last_wins(K.tag_batch(a.coalesce(1), 0)).collect()}
    assert only_a == {"x": 2.0}  # later row of the same batch wins


def test_keyed_table_insert_is_idempotent(spark, readings):
    table = K.KeyedTable(spark, scratch_path(spark, "t-keyed"))
    table.insert(readings, batch_seq=0)
    table.insert(readings.withColumn("pm2_5", F.col("pm2_5") + 1), batch_seq=1)
    table.insert(readings.withColumn("pm2_5", F.col("pm2_5") + 1), batch_seq=1)  # replayed batch
    assert table.batches() == [0, 1]
    cur = table.current()
    assert cur.count() == readings.count()
    diff = cur.join(readings.select("city", "time", F.col("pm2_5").alias("p0")), ["city", "time"])
    assert diff.filter(F.col("pm2_5").isNotNull() & (F.col("pm2_5") != F.col("p0") + 1)).count() == 0
    assert table.compact().count() == readings.count()
    last = table.batches()[-1]
    assert table.snapshots() == [last]
    # reads start from the snapshot: later batches win, and only they are read from the log
    newer = readings.limit(3).withColumn("pm2_5", F.lit(-7.0))
    table.insert(newer)
    seen = table.current()
    assert seen.count() == readings.count() and seen.filter("pm2_5 = -7").count() == 3
    # a replayed batch removes the snapshot that holds it; the view is that of the whole log
    table.insert(readings.limit(0), last)
    assert table.snapshots() == []
    assert table.current().filter("pm2_5 = -7").count() == 3


def test_retention_inclusive_global_cutoff(spark, readings):
    mx = readings.agg(F.max("time")).first()[0]
    kept = K.retain(readings)
    assert kept.agg(F.min("time")).first()[0] >= mx - dt.timedelta(hours=168)
    exact = readings.filter(F.col("time") >= F.lit(mx - dt.timedelta(hours=168)).cast("timestamp_ntz")).count()
    assert kept.count() == exact


def test_fallback_prefers_store(spark, readings):
    path = scratch_path(spark, "t-store")
    readings.limit(5).write.parquet(path)
    assert K.read_with_fallback(spark, path, readings, None).count() == 5
    assert K.read_with_fallback(spark, path + "-absent", readings, None).count() == readings.count()


def test_publish_tolerates_later_sink_failure(spark, readings):
    def boom(df):
        raise RuntimeError("remote down")
    status = K.publish(readings.limit(1), [("local", lambda d: d.count()), ("remote", boom)])
    assert status["local"] is None and "remote down" in status["remote"]


def test_tail_and_latest(readings):
    tail = SEL.tail_n(readings, 10)
    assert tail.groupBy("city").count().agg(F.max("count")).first()[0] == 10
    latest = SEL.latest_row(readings)
    want = readings.groupBy("city").agg(F.max("time").alias("time"))
    assert _rows(latest) == _rows(want)


def test_split_matches_row_order(spark, readings):
    s = chrono_split(readings.select("city", "time"), 0.8).toPandas()
    p = s.sort_values(["time", "city"]).reset_index(drop=True)
    k = int(len(p) * 0.8)
    assert p["is_train"].tolist() == [True] * k + [False] * (len(p) - k)


def test_split_with_ties_at_cut(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(c, t0 + dt.timedelta(hours=h)) for h in range(3) for c in "abcd"]
    df = spark.createDataFrame(rows, "city string, time timestamp_ntz")
    s = chrono_split(df, 0.5).toPandas().sort_values(["time", "city"])
    assert s["is_train"].tolist() == [True] * 6 + [False] * 6


def test_archive_round_trip_and_ragged_rejected(spark):
    raw = raw_events(spark, SF)
    wpath, apath = FX.land_archive(raw)
    rows, rejected = ingest.read_archive(spark, wpath, apath)
    assert rows.count() == raw.count() and rejected.count() == 0
    bad = scratch_path(spark, "t-ragged")
    spark.createDataFrame([('{"city": "x", "hourly": {"time": ["2024-01-01T00:00"], "pm2_5": [1.0, 2.0]}}',),
                           ("not json",)], "value string").write.text(bad)
    r2, rej2 = ingest.flatten_archive(ingest.read_json(spark, bad, ingest.ARCHIVE_SCHEMAS["air"]), ingest.AIR_VARS)
    assert r2.count() == 0 and rej2.count() == 2


def test_mixed_csv_and_empty_input(spark, readings):
    path = FX.land_mixed_csv(readings)
    back = ingest.read_readings_csv(spark, path)
    assert _rows(back) == _rows(readings)
    assert ingest.read_or_empty(spark, path + "-absent", READINGS_SCHEMA).count() == 0


def test_per_city_sink(spark, readings):
    path = scratch_path(spark, "t-percity")
    ingest.write_per_city(readings, path)
    parts = {p.name for p in __import__("pathlib").Path(path.replace("file:", "")).iterdir() if p.is_dir()}
    assert parts == {f"city_part={c.lower()}" for c in [r[0] for r in readings.select("city").distinct().collect()]}


def test_normalise_names(spark):
    df = spark.createDataFrame([(1,)], "`A Col` int")
    assert ingest.normalise_names(df).columns == ["a_col"]


def test_feature_csv_round_trip_and_total_order(spark, readings):
    from smogline.plans import features as FT
    from smogline.schemas import FEATURE_COLUMNS
    feats = FT.build_features(readings, drop_incomplete=True)
    path = scratch_path(spark, "t-feat-csv")
    ingest.write_table(SEL.total_order(feats, global_sort=True), path, fmt="csv")
    back = ingest.read_features_csv(spark, path)
    assert back.columns == FEATURE_COLUMNS
    assert back.count() == feats.count()
    a = feats.select("city", "time", "aqi_lag_24h", "target_aqi_72h").exceptAll(
        back.select("city", "time", "aqi_lag_24h", "target_aqi_72h"))
    assert a.count() == 0
    rows = SEL.total_order(feats, global_sort=True).select("city", "time").collect()
    assert rows == sorted(rows, key=lambda r: (r["city"], r["time"]))
