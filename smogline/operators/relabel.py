"""Relabelling by change propagation (T6, W1-W5): late and corrected rows, and the rows whose windows they reach.

A feature row reads ``FEATURE_LOOKBACK`` rows before it and ``FEATURE_LOOKAHEAD`` after it, so a changed row reaches the rows from
lookahead before it to lookback after it, by position in its series. The readings lie in time buckets; from the number
of rows per (series, bucket) alone follow, as position ranges, the buckets that changed rows reach and those
that the windows of reached rows read. Ranges of a series that touch form islands; only the islands' buckets are opened, features are
built per island, and a window over the changed-row flag tells which rows are reached. The other rows
of an island serve as its edges. The result replaces the reached rows and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.features import build_features, feature_windows
from ..schemas import FEATURE_COLUMNS, KEY, READINGS_COLUMNS, TIME
from ..tables.buckets import BKT, BucketTable
from .windows import FEATURE_LOOKAHEAD, FEATURE_LOOKBACK

REACH_BEFORE, REACH_AFTER = FEATURE_LOOKAHEAD, FEATURE_LOOKBACK
ISLAND, DIRTY, REACHED = "_island", "_dirty", "_reached"


def islands(counts: DataFrame, dirty: DataFrame, key: str = KEY) -> DataFrame:
    """(key, bkt, _island): the buckets that a relabelling reads.

    ``counts``: (key, bkt, n) of the readings as they are now; ``dirty``: (key, bkt) with changed rows. A bucket is read when its
    positions come within reach of a dirty bucket's, and the windows' own reach beyond that. Both steps are running sums
    and one range join over the bucket table; no reading is touched."""
    before = Window.partitionBy(key).orderBy(BKT)
    placed = counts.withColumns({
        "lo": F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "nth": F.row_number().over(before)})
    placed = placed.withColumn("hi", F.col("lo") + F.col("n"))
    margin_before, margin_after = REACH_BEFORE + FEATURE_LOOKBACK, REACH_AFTER + FEATURE_LOOKAHEAD
    spans = (placed.join(dirty.select(key, BKT).distinct(), [key, BKT])
             .select(F.col(key).alias("_k"), (F.col("lo") - margin_before).alias("a"), (F.col("hi") + margin_after).alias("b")))
    # ranges of a series that touch become one, so that the join below meets a bucket with few of them
    run = Window.partitionBy("_k").orderBy("a", "b")
    reach = F.max("b").over(run.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(reach >= F.col("a"), 0).otherwise(1))
    spans = (spans.withColumn("nr", F.sum("new").over(run.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy("_k", "nr").agg(F.min("a").alias("a"), F.max("b").alias("b")))
    read = (placed.join(spans, (F.col(key) == F.col("_k")) & (F.col("lo") < F.col("b")) & (F.col("hi") > F.col("a")))
            .select(key, BKT, "nth").distinct())
    # neighbouring buckets form an island: their numbers rise with their place
    by = Window.partitionBy(key).orderBy("nth")
    return read.withColumn(ISLAND, F.col("nth") - F.row_number().over(by)).select(key, BKT, ISLAND)


def relabel(readings: BucketTable, dirty: DataFrame) -> tuple[DataFrame, list[int]]:
    """Features of all rows that the changed keys ``dirty`` (city, time) reach, and the buckets read for them."""
    keys = dirty.select(KEY, TIME).distinct()
    where = islands(readings.counts(KEY), keys.withColumn(BKT, readings.bucket())).persist()
    opened = sorted(r[BKT] for r in where.select(BKT).distinct().collect())      # time buckets: few, whatever the rows
    if not opened:
        return build_features(readings.read(), drop_incomplete=False).limit(0), opened
    rows = readings.read(opened).select(*READINGS_COLUMNS).withColumn(BKT, readings.bucket())
    rows = rows.join(where, [KEY, BKT]).drop(BKT)
    rows = rows.join(keys.withColumn(DIRTY, F.lit(True)), [KEY, TIME], "left")

    def compute(d, w):
        near = F.max(F.coalesce(DIRTY, F.lit(False))).over(w.rowsBetween(-REACH_AFTER, REACH_BEFORE))
        return feature_windows(d.withColumn(REACHED, near), w)

    built = build_features(rows, drop_incomplete=False, key=(KEY, ISLAND), compute=compute, keep=(REACHED,))
    return built.filter(REACHED).select(*FEATURE_COLUMNS), opened


class Relabelling:
    """Readings and complete-row features as bucket tables; a batch of late or corrected readings updates both."""

    def __init__(self, readings: BucketTable, features: BucketTable):
        self.readings, self.features = readings, features

    def load(self, rows: DataFrame) -> None:
        """First build: all features, as batch 0."""
        self.readings.append(rows.select(*READINGS_COLUMNS), 0)
        self.features.append(build_features(self.readings.read()), 0)

    def update(self, rows: DataFrame, batch: int) -> list[int]:
        """One later batch (from 1 on, any order of times); a replay of a batch gives the same tables. Returns the buckets read."""
        rows = rows.select(*READINGS_COLUMNS)
        self.readings.append(rows, batch)
        reached, opened = relabel(self.readings, rows)
        complete = F.col("aqi_lag_24h").isNotNull() & F.col("target_aqi_72h").isNotNull()
        self.features.append(reached.filter(complete), batch, gone=reached)
        return opened
