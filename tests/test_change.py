"""Late data and publishing: bucket table, relabelling against a full build, outbox, and the jobs that use them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from smogline.operators import relabel as RL
from smogline.plans import jobs as J
from smogline.plans.features import build_features
from smogline.schemas import FEATURE_COLUMNS, READINGS_COLUMNS, READINGS_SCHEMA
from smogline.session import scratch_path
from smogline.sources.paths import list_dirs
from smogline.tables.buckets import BucketTable, by_hash, by_time
from smogline.tables.keyed import KeyedTable
from smogline.tables.outbox import Outbox, PublishError, folder_sink

START = dt.datetime(2024, 1, 1)


def readings(spark, rows):
    """Rows (city, hour, aqi): the other columns follow from the hour."""
    full = [(START + dt.timedelta(hours=h), c, *[float(h % (7 + i)) for i in range(16)], a) for c, h, a in rows]
    return spark.createDataFrame(full, READINGS_SCHEMA)


def same(a, b, cols):
    def rounded(df):
        return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.select(*cols).dtypes])
    a, b = rounded(a).persist(), rounded(b).persist()
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_bucket_table_merges_replays_compacts_and_forgets(spark):
    path = scratch_path(spark, "t-buckets")
    table = BucketTable(spark, path, by_hash(3), merge_at=3, retain_hours=100)
    rng = random.Random(1)
    state = {}
    for batch in range(7):
        rows = {(f"c{rng.randrange(6)}", 20 * batch + rng.randrange(40)): rng.randrange(500) for _ in range(25)}
        state.update(rows)
        touched = table.append(readings(spark, [(*k, a) for k, a in rows.items()]), batch)
        assert set(touched) == {r["b"] for r in readings(spark, [(*k, 1) for k in rows]).select(by_hash(3)().alias("b")).distinct().collect()}
        if batch == 3:                                  # a replay changes nothing
            table.append(readings(spark, [(*k, a) for k, a in rows.items()]), batch)
    newest = max(h for _, h in state)
    want = {(c, START + dt.timedelta(hours=h), a) for (c, h), a in state.items() if h >= newest - 100}
    assert {tuple(r) for r in table.read().select("city", "time", "aqi").collect()} == want
    assert max(len([e for e in table.entries() if e["bkt"] == b]) for b in table.buckets()) < 3
    one = table.buckets()[0]
    assert {f.split("/bkt=")[1].split("/")[0] for f in table.read([one]).inputFiles()} == {str(one)}
    dead = table.vacuum()
    assert dead and not {f"v={v}" for v in dead} & set(list_dirs(spark, f"{path}/data"))
    again = BucketTable(spark, path, by_hash(3), merge_at=3, retain_hours=100)      # another process: no schemas in memory
    assert {tuple(r) for r in again.read().select("city", "time", "aqi").collect()} == want


def test_bucket_table_ties_and_removed_keys(spark):
    got = set()
    for parts in (1, 4):
        table = BucketTable(spark, scratch_path(spark, "t-ties"), by_time())
        rows = readings(spark, [("a", 1, v) for v in range(20)] + [("b", 2, 5), ("b", 300, 6)])
        table.append(rows.repartition(parts, "aqi"), 0)
        gone = readings(spark, [("b", 2, 0), ("b", 300, 0)])
        table.append(readings(spark, [("b", 300, 9)]), 1, gone=gone)
        got.add(tuple(sorted(tuple(r) for r in table.read().select("city", "aqi").collect())))
    assert len(got) == 1 and [r[0] for r in got.pop()] == ["a", "b"]


def made(rng, cities, hours):
    return [(c, h, rng.choice([None] + list(range(300)))) for c, n in cities for h in sorted(rng.sample(range(hours), n))]


def test_relabelled_features_equal_a_full_build(spark):
    rng = random.Random(2)
    rows = made(rng, [("hot", 2600), ("mid", 700), ("few", 30)], 3000)
    late = [r for r in rows if rng.random() < 0.004 or (r[0] == "few" and r[1] % 9 == 0)]
    job = RL.Relabelling(*[BucketTable(spark, scratch_path(spark, "t-relabel"), by_time(24)) for _ in range(2)])
    job.load(readings(spark, [r for r in rows if r not in late]))
    opened = job.update(readings(spark, late), 1)
    fixed = [("hot", h, 400) for c, h, _ in rows if c == "hot" and 1500 < h < 1504] + [("new", 5, 1)]
    narrow = job.update(readings(spark, fixed), 2)
    narrow = job.update(readings(spark, fixed), 2)                       # a replay
    assert 0 < len(narrow) < len(job.readings.buckets()) / 4 and len(opened) > len(narrow)
    now = {(c, h): a for c, h, a in rows} | {(c, h): a for c, h, a in fixed}
    full = build_features(readings(spark, [(*k, a) for k, a in now.items()]))
    assert same(job.features.read(), full, FEATURE_COLUMNS)
    # chunks out of reach are not opened
    reached, buckets = RL.relabel(job.readings, readings(spark, fixed))
    files = job.readings.read(buckets).inputFiles()
    assert {int(f.split("/bkt=")[1].split("/")[0]) for f in files} == set(buckets)
    assert reached.groupBy("city").count().collect()


def test_islands_reach_by_position(spark):
    counts = spark.createDataFrame([("a", b, 50) for b in range(20)] + [("b", 3, 5)], "city string, bkt long, n long")
    dirty = spark.createDataFrame([("a", 9)], "city string, bkt long")
    got = sorted(r["bkt"] for r in RL.islands(counts, dirty).collect())
    # positions 450 to 500 are dirty: reads from 450 - 96 up to 500 + 96
    assert got == list(range(7, 12))
    two = spark.createDataFrame([("a", 1), ("a", 15), ("b", 3)], "city string, bkt long")
    assert RL.islands(counts, two).select("city", "_island").distinct().count() == 3


def test_outbox_delivers_once_after_failures(spark):
    root = scratch_path(spark, "t-outbox")
    box = Outbox(spark, root)
    rows = spark.range(30).withColumn("b", F.col("id") % 3)
    for b in range(3):
        box.enqueue(rows.filter(F.col("b") == b), b, ("main", "copy"), required=("main",))
    seen, down = [], {0: True}

    def flaky(frame, batch):
        seen.append(batch)
        if batch == 1 and down[0]:
            raise OSError("down")
        folder_sink(f"{root}/copy")(frame, batch)

    first = box.drain({"main": folder_sink(f"{root}/main"), "copy": flaky})
    assert first[(1, "copy")].startswith("OSError") and (2, "copy") not in first     # in order: batch 2 waits for batch 1
    assert {(r["batch"], r["sink"]) for r in box.pending()} == {(1, "copy"), (2, "copy")}
    assert box.trim() == [0]
    down[0] = False
    assert Outbox(spark, root).drain({"copy": flaky}) == {(1, "copy"): None, (2, "copy"): None}
    assert Outbox(spark, root).drain({"copy": flaky, "main": flaky}) == {}
    assert seen == [0, 1, 1, 2]
    assert sorted(r["id"] for r in spark.read.parquet(f"{root}/copy/*").collect()) == list(range(30))
    state = {(r["batch"], r["sink"]): (r["status"], r["attempts"]) for r in box.ledger().collect()}
    assert state[(1, "copy")] == ("delivered", 2) and state[(0, "main")] == ("delivered", 1)
    box.enqueue(rows.limit(1), 3, ("main",), required=("main",))
    with pytest.raises(PublishError):
        box.drain({"main": lambda frame, batch: 1 / 0})
    assert [(r["batch"], r["attempts"]) for r in box.pending()] == [(3, 1)]


def test_feature_job_stores_rejects_dedupes_and_publishes(spark):
    root = scratch_path(spark, "t-features-job")
    rng = random.Random(4)
    rows = made(rng, [("a", 150)], 160)
    frame = readings(spark, rows + rows[:20]).withColumn("temperature_2m", F.when(F.col("time") == F.lit(START), F.lit(float("nan")))
                                                         .otherwise(F.col("temperature_2m")))
    bad = readings(spark, [(None, 3, 4)])
    frame.unionByName(bad).write.parquet(f"{root}/in")
    assert J.feature_job(spark, f"{root}/in", f"{root}/store", sinks={"out": folder_sink(f"{root}/out")}) == 0
    want = build_features(readings(spark, rows).withColumn("temperature_2m", F.when(F.col("time") != F.lit(START), F.col("temperature_2m"))))
    assert same(KeyedTable(spark, f"{root}/store").current(), want, FEATURE_COLUMNS)
    assert spark.read.parquet(f"{root}/store/quarantine").count() == 1
    assert spark.read.parquet(f"{root}/out/*").count() == want.count()
    assert J.feature_job(spark, f"{root}/nowhere", f"{root}/empty") == 0


def test_relabel_job_feeds_training(spark):
    root = scratch_path(spark, "t-relabel-job")
    rng = random.Random(5)
    rows = made(rng, [("a", 400)], 420)
    readings(spark, rows[:300]).write.parquet(f"{root}/first")
    readings(spark, rows[300:]).write.parquet(f"{root}/later")
    J.relabel_job(spark, f"{root}/first", f"{root}/t", 0)
    J.relabel_job(spark, f"{root}/later", f"{root}/t", 1)
    feats = BucketTable(spark, f"{root}/t/features", by_time()).read()
    # rows of the first batch have their targets now
    assert same(feats, build_features(readings(spark, rows)), FEATURE_COLUMNS)


def test_keyed_log_counts_whole_batches_and_can_be_trimmed(spark):
    path = scratch_path(spark, "t-trim")
    table = KeyedTable(spark, path)
    table.insert(readings(spark, [("a", 1, 1), ("a", 2, 2)]))
    table.insert(readings(spark, [("a", 2, 3), ("b", 2, 4)]))
    readings(spark, [("a", 9, 9)]).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{path}/log/batch_seq=2/month_part=2024-01")
    want = [("a", 1), ("a", 3), ("b", 4)]
    assert sorted((r["city"], r["aqi"]) for r in table.current().collect()) == want     # batch 2 is half written
    table.insert(readings(spark, [("c", 1, 5)]), batch_seq=2)
    assert sorted((r["city"], r["aqi"]) for r in table.compact(trim=True).collect()) == want + [("c", 5)]
    assert table.batches() == [] and table.next_batch() == 3
    table.insert(readings(spark, [("a", 1, 7)]))
    assert sorted((r["city"], r["aqi"]) for r in table.current().collect()) == [("a", 3), ("a", 7), ("b", 4), ("c", 5)]
    with pytest.raises(ValueError):
        table.insert(readings(spark, [("a", 1, 8)]), batch_seq=1)
