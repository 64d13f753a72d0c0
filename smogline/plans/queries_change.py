"""Registered queries for late data and publishing: relabelling, bucketed buffer, outbox."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aqi as AQ
from ..operators.relabel import Relabelling
from ..schemas import READINGS_COLUMNS
from ..session import scratch_path
from ..sources.adapter import raw_events
from ..tables.buckets import BucketTable, by_hash, by_time
from ..tables.outbox import Outbox, folder_sink
from .queries_core import RAW, STD_COLS, features_sql
from .registry import register, stable

LIVE_AQI = AQ.aqi_sql(missing="skip")
_RAW_COLS = ", ".join(c for c in READINGS_COLUMNS if c != "aqi")
HOUR_SQL = "(date_diff('day', DATE '1970-01-01', CAST(time AS DATE)) * 24 + hour(time))"


def hour_number():
    return F.datediff(F.to_date("time"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour("time")


# rows of some hours come late, others are corrected (pm2_5 + 10); the result must be that of a full build
CORRECTED_SQL = (f"SELECT {_RAW_COLS}, {LIVE_AQI} AS aqi FROM (SELECT * REPLACE "
                 f"(CASE WHEN {HOUR_SQL} % 89 = 7 THEN pm2_5 + 10e0 ELSE pm2_5 END AS pm2_5) FROM ({RAW}) r) c")


@register("relabel", features_sql(CORRECTED_SQL))
def q_relabel(spark, sf):
    """First all readings but the late ones; then two batches with late and corrected rows, relabelled in place."""
    raw = raw_events(spark, sf)
    late, corrected = hour_number() % 97 == 5, hour_number() % 89 == 7
    fixed = raw.withColumn("pm2_5", F.when(corrected, F.col("pm2_5") + F.lit(10.0)).otherwise(F.col("pm2_5")))
    both = [f.withColumn("aqi", AQ.aqi(missing="skip")).select(*READINGS_COLUMNS) for f in (raw, fixed)]
    root = scratch_path(spark, "relabel")
    job = Relabelling(BucketTable(spark, f"{root}/readings", by_time()), BucketTable(spark, f"{root}/features", by_time()))
    job.load(both[0].filter(~late))
    job.update(both[1].filter(late), 1)
    job.update(both[1].filter(corrected), 2)
    return stable(job.features.read(), STD_COLS)


PUBLISH_SQL = (f"SELECT {_RAW_COLS}, {LIVE_AQI} AS aqi, CAST({HOUR_SQL} % 3 AS BIGINT) AS batch FROM ({RAW}) r")


@register("publish_outbox", PUBLISH_SQL)
def q_publish(spark, sf):
    """K7 + S8: three batches for two sinks; one sink is down for its second batch. A second run delivers the rest, and the
    late sink holds every row of every batch once."""
    rows = raw_events(spark, sf).withColumn("aqi", AQ.aqi(missing="skip")).select(*READINGS_COLUMNS).withColumn("batch", hour_number() % 3)
    root = scratch_path(spark, "outbox")
    box = Outbox(spark, root)
    for b in range(3):
        box.enqueue(rows.filter(F.col("batch") == b), b, ("store", "mirror"), required=("store",))
    store, mirror = folder_sink(f"{root}/store"), folder_sink(f"{root}/mirror")

    def down(frame, batch):
        if batch == 1:
            raise ConnectionError("sink is down")
        mirror(frame, batch)

    box.drain({"store": store, "mirror": down})
    box.drain({"store": store, "mirror": mirror})
    return spark.read.parquet(f"{root}/mirror/*").select(*READINGS_COLUMNS, "batch")


BUFFER_SQL = (f"WITH f AS ({CORRECTED_SQL}) SELECT * FROM f WHERE time >= (SELECT max(time) FROM f) - INTERVAL 168 HOUR")


@register("buffer_buckets", BUFFER_SQL)
def q_buffer_buckets(spark, sf):
    """The buffer as hash buckets fed by six small batches (in order of the hour modulo 6, corrections last), merged on read and
    compacted on the way, with the 168 h retention."""
    raw = raw_events(spark, sf)
    corrected = hour_number() % 89 == 7
    rows = raw.withColumn("aqi", AQ.aqi(missing="skip")).select(*READINGS_COLUMNS)
    table = BucketTable(spark, scratch_path(spark, "buckets"), by_hash(4))
    for b in range(6):
        table.append(rows.filter(hour_number() % 6 == b), b)
    fixed = raw.filter(corrected).withColumn("pm2_5", F.col("pm2_5") + F.lit(10.0)).withColumn("aqi", AQ.aqi(missing="skip"))
    table.append(fixed.select(*READINGS_COLUMNS), 6)
    return table.read(hours=168)
