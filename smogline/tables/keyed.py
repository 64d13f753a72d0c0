"""Keyed feature table on plain Parquet.

Layout: an append-only log under ``<path>/log`` partitioned by ``month`` of the event time, every row
tagged with the ``batch_seq`` of its insert and a ``row_seq`` inside the batch. The current table is
the last-wins view over the log (highest ``batch_seq``, then highest ``row_seq`` per key). Compaction
writes that view as ``<path>/snapshot/upto=<batch_seq>``; from then on the view reads the newest whole
snapshot and only the later batches of the log. Inserts are idempotent per ``batch_seq``: re-running a
batch overwrites only its own folder, and snapshots that hold the batch are removed first. Batches count only
once they are written whole. The log stays whole, so a snapshot can always be made again, unless
``compact(trim=True)`` deletes what the snapshot covers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.paths import exists, list_dirs, remove
from ..functions.calendar import ntz_lit

BATCH = "batch_seq"
ROW = "row_seq"
MONTH = "month_part"
KEYS = ("city", "time")
BUFFER_RETENTION_HOURS = 24 * 7


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Concatenation by column name; missing columns become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def tag_batch(df: DataFrame, batch_seq: int | None = None, batch_col=None, order: str | None = None) -> DataFrame:
    """Adds ``batch_seq`` (literal or column) and ``row_seq``: the column ``order`` if it is named, else the
    order of the input partitions (arbitrary between equal keys that different files hold)."""
    b = F.lit(batch_seq).cast("long") if batch_col is None else batch_col.cast("long")
    return df.withColumn(BATCH, b).withColumn(
        ROW, F.col(order).cast("long") if order else F.monotonically_increasing_id())


def last_wins(df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = (BATCH, ROW),
              drop_order: bool = True) -> DataFrame:
    """K2: one row per key, the one with the highest ``order``.

    Written as ``row_number() = 1`` per key: one shuffle by key, before which a ``WindowGroupLimit`` keeps one
    row per key and map task, so a key that is repeated often does not meet in one task.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    out = df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1).drop("_rk")
    return out.drop(*order) if drop_order else out


def retention_cutoff(df: DataFrame, hours: int = BUFFER_RETENTION_HOURS, time: str = "time"):
    """Global max(time) - hours, computed as one scalar aggregate (None on an empty table)."""
    row = df.agg(F.max(time).alias("m")).first()
    if row is None or row["m"] is None:
        return None
    return row["m"] - __import__("datetime").timedelta(hours=hours)


def retain(df: DataFrame, hours: int = BUFFER_RETENTION_HOURS, time: str = "time",
           reference: DataFrame | None = None) -> DataFrame:
    """K4: keep rows with time >= max(time) - hours (inclusive, global max, as the reference).

    The cutoff is a literal, so the filter prunes row groups of a Parquet log, and its month partitions
    where ``df`` still has the month column.
    ``reference`` may give a cheaper input with the same max time (e.g. the union before last-wins)."""
    cutoff = retention_cutoff(reference if reference is not None else df, hours, time)
    if cutoff is None:
        return df
    kept = df.filter(F.col(time) >= ntz_lit(cutoff))
    # a log that still has its month partition is pruned by it
    return kept.filter(F.col(MONTH) >= F.lit(cutoff.strftime("%Y-%m"))) if MONTH in df.columns else kept


class KeyedTable:
    """Append log + last-wins view for a table with primary key ``keys`` and event time ``time``."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = KEYS, time: str = "time"):
        self.spark, self.path, self.keys, self.time = spark, path.rstrip("/"), list(keys), time

    @property
    def log_path(self) -> str:
        return f"{self.path}/log"

    def exists(self) -> bool:
        return exists(self.spark, self.log_path) or bool(self.snapshots())

    def batches(self) -> list[int]:
        return sorted(int(b.split("=", 1)[1]) for b in list_dirs(self.spark, self.log_path)
                      if b.startswith(f"{BATCH}="))

    def next_batch(self) -> int:
        b = self.batches() + self.snapshots()
        return (max(b) + 1) if b else 0

    def insert(self, df: DataFrame, batch_seq: int | None = None, order: str | None = None) -> int:
        """K1: append one batch. A batch owns one folder (``batch_seq=n``), which a replay overwrites whole, so
        months that the replay no longer has go too. ``order`` names a column that orders equal keys within
        the batch; without it their order is that of the input partitions."""
        seq = self.next_batch() if batch_seq is None else int(batch_seq)
        for upto in self.snapshots():
            if upto >= seq:
                if upto not in self.batches():
                    raise ValueError(f"batch {seq} can't be replayed: the log up to {upto} has been trimmed")
                remove(self.spark, self._snapshot_path(upto))
        tagged = tag_batch(df, seq, order=order).withColumn(MONTH, F.date_format(F.col(self.time), "yyyy-MM"))
        (tagged.drop(BATCH).write.mode("overwrite").option("partitionOverwriteMode", "static")
         .partitionBy(MONTH).parquet(f"{self.log_path}/{BATCH}={seq}"))
        return seq

    def log(self, after: int | None = None) -> DataFrame | None:
        """Rows of the whole batches (a batch that is being written, or was left half written, has no ``_SUCCESS`` and does
        not count), from those after ``after``; None where there are none."""
        whole = [f"{self.log_path}/{BATCH}={b}" for b in self.batches() if (after is None or b > after)
                 and exists(self.spark, f"{self.log_path}/{BATCH}={b}/_SUCCESS")]
        whole = [w for w in whole if list_dirs(self.spark, w)]          # a batch without rows has no folder of a month
        if not whole:
            return None
        return (self.spark.read.option("basePath", self.log_path).option("mergeSchema", True).parquet(*whole)
                .withColumn(BATCH, F.col(BATCH).cast("long")))

    def current(self, since=None) -> DataFrame:
        """K2 view. ``since`` (a timestamp) prunes month partitions before the last-wins step."""
        return self._view(since).drop(BATCH, ROW)

    def _view(self, since=None) -> DataFrame:
        """The current rows with the batch and row numbers of their insert."""
        snapshots = self.snapshots()
        rows = self.log(snapshots[-1] if snapshots else None)
        if snapshots:
            held = self.spark.read.parquet(self._snapshot_path(snapshots[-1]))
            rows = held if rows is None else union_by_name(held, rows)
        if rows is None:
            raise FileNotFoundError(f"no whole batch with rows in {self.log_path}")
        if since is not None:
            rows = rows.filter(F.col(MONTH) >= F.lit(since.strftime("%Y-%m"))).filter(
                F.col(self.time) >= ntz_lit(since))
        return last_wins(rows.drop(MONTH), self.keys, drop_order=False)

    def _snapshot_path(self, upto: int) -> str:
        return f"{self.path}/snapshot/upto={upto}"

    def snapshots(self) -> list[int]:
        """Last batches of the snapshots that are written whole, in order."""
        found = sorted(int(d.split("=", 1)[1]) for d in list_dirs(self.spark, f"{self.path}/snapshot")
                       if d.startswith("upto="))
        return [n for n in found if exists(self.spark, f"{self._snapshot_path(n)}/_SUCCESS")]

    def compact(self, trim: bool = False) -> DataFrame:
        """K3: write the current view as the snapshot that later reads start from, partitioned by month. With ``trim`` the
        batches and older snapshots that it covers are deleted once it is whole; those batches can't be replayed any more."""
        upto = self.batches()[-1] if self.batches() else self.snapshots()[-1]
        if upto not in self.snapshots():
            (self._view().withColumn(MONTH, F.date_format(F.col(self.time), "yyyy-MM")).write.mode("overwrite")
             .partitionBy(MONTH).parquet(self._snapshot_path(upto)))
        if trim:
            for b in [b for b in self.batches() if b <= upto]:
                remove(self.spark, f"{self.log_path}/{BATCH}={b}")
            for older in self.snapshots()[:-1]:
                remove(self.spark, self._snapshot_path(older))
        return self.current()


def seed_buffer(history: DataFrame, hours: int = BUFFER_RETENTION_HOURS) -> DataFrame:
    """K5: first run without a buffer: the tail of the full history with the retention cutoff."""
    return retain(history, hours)


def upsert_buffer(buffer: DataFrame, new_rows: DataFrame, hours: int = BUFFER_RETENTION_HOURS,
                  keys: Sequence[str] = KEYS) -> DataFrame:
    """T3 step: buffer + new rows, last wins per key, then the global retention cutoff."""
    both = union_by_name(tag_batch(buffer, 0), tag_batch(new_rows, 1))
    return retain(last_wins(both, keys), hours, reference=both.select("time"))


def read_with_fallback(spark: SparkSession, store_path: str | None, batch: DataFrame,
                       live: DataFrame | None, keys: Sequence[str] = KEYS) -> DataFrame:
    """K6: the store if present (a keyed table by its current view, else plain Parquet), else the batch
    table plus live rows, last wins (live after batch).

    A live row (null targets) replaces a labelled batch row with the same key, as in the reference."""
    if store_path and exists(spark, store_path):
        store = KeyedTable(spark, store_path, keys)
        return store.current() if store.exists() else spark.read.parquet(store_path)
    if live is None:
        return batch
    both = union_by_name(tag_batch(batch, 0), tag_batch(live, 1))
    return last_wins(both, keys)


def publish(df: DataFrame, sinks) -> dict:
    """K7: write to every sink in order; the first is required, later ones may fail without
    failing the run. Returns {sink name: error or None}."""
    status = {}
    for i, (name, fn) in enumerate(sinks):
        try:
            fn(df)
            status[name] = None
        except Exception as e:  # noqa: BLE001 - best-effort sinks report and continue
            if i == 0:
                raise
            status[name] = repr(e)
    return status
