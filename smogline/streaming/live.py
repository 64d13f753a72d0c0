"""Hourly live pipeline as a Structured Streaming job.

readStream (landed readings, Parquet or JSON) -> index per row (T2, stateless) -> foreachBatch:

0. rows without series or time go to ``quarantine/batch=<batch_id>`` with a reason, NaN becomes null (S8, N19);
1. buffer upsert (T3): the rows as one delta of the bucketed buffer, last wins per (city, time) ordered by landing sequence,
   retention max(time) - 168 h (K4), first filled from the tail of the history (K5); rows that are older
   than the cutoff are quarantined;
2. live features (T4): last 48 + m rows per city (m = new rows of the city) of the touched buckets, feature build without
   the complete-row filter, semi join back to the new keys (J2);
3. accumulation (T5): the new feature rows go to a keyed table under ``batch_seq = batch_id``;
4. publishing (K7): they are enqueued in the outbox for every sink, and what is pending is offered.

Every write of a micro-batch is keyed by its ``batch_id`` and overwrites its own directory, so a
micro-batch that is replayed after a failure produces the same state (idempotent sinks); the
streaming checkpoint records which files were consumed. A replayed hour (same key) replaces the
earlier row (last wins, T6; of two rows with one key and landing sequence the one with the greater content hash).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aqi import aqi
from ..functions.calendar import ntz_lit
from ..operators.joins import new_keys_semi
from ..operators.select import tail_per_series
from ..plans.features import build_features
from ..schemas import FEATURE_COLUMNS, RAW_SCHEMA, READINGS_COLUMNS
from ..sources.ingest import normalise_nan, quarantine_split
from ..tables.buckets import BucketTable, by_hash
from ..tables.keyed import BUFFER_RETENTION_HOURS, KeyedTable, seed_buffer
from ..tables.outbox import Outbox

HISTORY_ROWS = 48
LANDED = "landed_seq"


def readings_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None,
                    schema=None) -> DataFrame:
    """T1 + T2: landed raw readings as a stream, with the index computed per row (live rule)."""
    from pyspark.sql import types as T
    schema = schema or T.StructType(RAW_SCHEMA.fields + [T.StructField(LANDED, T.LongType())])
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path).withColumn("aqi", aqi(missing="skip"))


class LiveJob:
    """State lives under ``root``: the ``buffer`` buckets, the ``live_features`` table, ``quarantine`` and ``outbox``.

    ``sinks``: {name: function of (rows, batch id)}; those in ``required`` fail the micro-batch when they fail."""

    def __init__(self, spark: SparkSession, root: str, history: DataFrame | None = None,
                 retention_hours: int = BUFFER_RETENTION_HOURS, history_rows: int = HISTORY_ROWS,
                 features: bool = True, sinks: dict | None = None, required=(), buckets: int = 16):
        self.spark, self.root = spark, root.rstrip("/")
        self.history, self.retention, self.history_rows = history, retention_hours, history_rows
        self.features, self.sinks, self.required = features, sinks or {}, required
        self.buffer = BucketTable(spark, f"{self.root}/buffer", by_hash(buckets), retain_hours=retention_hours)
        self.live = KeyedTable(spark, f"{self.root}/live_features")
        self.outbox = Outbox(spark, f"{self.root}/outbox")

    # -- state ------------------------------------------------------------------------------------
    def _versions(self) -> list[int]:
        return self.buffer._versions()

    def quarantine(self) -> DataFrame:
        """Rejected rows of all micro-batches, with the reason and their batch."""
        return self.spark.read.option("basePath", f"{self.root}/quarantine").parquet(f"{self.root}/quarantine")

    # -- one micro-batch --------------------------------------------------------------------------
    def process(self, batch: DataFrame, batch_id: int) -> None:
        valid, bad = quarantine_split(batch.select(*READINGS_COLUMNS, LANDED))
        new_rows = normalise_nan(valid)
        if not self.buffer.exists() and self.history is not None:
            self.buffer.append(seed_buffer(self.history, self.retention).select(*READINGS_COLUMNS), 0)
        touched = self.buffer.append(new_rows, batch_id + 1, order=LANDED)
        self.buffer.vacuum()
        cutoff = self.buffer.cutoff()
        late = new_rows.filter(F.col("time") < ntz_lit(cutoff)) if cutoff is not None else new_rows.limit(0)
        rejected = bad.unionByName(late.withColumn("reason", F.lit("older than the retention")))
        rejected.write.mode("overwrite").parquet(f"{self.root}/quarantine/batch={batch_id}")
        if not self.features or not touched:
            return
        buf = self.buffer.read(touched).select(*READINGS_COLUMNS).persist()
        kept_new = new_keys_semi(buf, new_rows)
        m = kept_new.groupBy("city").agg(F.count(F.lit(1)).alias("_m"))
        recent = tail_per_series(
            buf.join(m, on="city", how="inner").withColumn("_n", F.col("_m") + F.lit(self.history_rows)), "_n"
        ).drop("_m", "_n")
        # the buffer holds at most the retention window per city, so the plain per-city window is bounded
        feats = build_features(recent, drop_incomplete=False, chunk_rows=None)
        self.live.insert(new_keys_semi(feats, kept_new), batch_seq=batch_id)
        buf.unpersist()
        if self.sinks:
            written = self.live.log()
            if written is not None:
                mine = written.filter(F.col("batch_seq") == batch_id).select(*FEATURE_COLUMNS)
                self.outbox.enqueue(mine, batch_id, self.sinks, self.required)
        self.publish()

    def publish(self) -> dict:
        """Offers what is pending to the sinks (also after a run in which a sink was down)."""
        return self.outbox.drain(self.sinks) if self.sinks else {}

    # -- driver -----------------------------------------------------------------------------------
    def run(self, stream: DataFrame, checkpoint: str, available_now: bool = True):
        q = (stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint))
        q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 hour")
        handle = q.start()
        if available_now:
            handle.awaitTermination()
        return handle

    def live_features(self) -> DataFrame:
        return self.live.current()

    def latest_buffer(self) -> DataFrame:
        return self.buffer.read().select(*READINGS_COLUMNS)
