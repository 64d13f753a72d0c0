"""Bucketed keyed table: small deltas, merge on read, compaction of touched buckets.

A row belongs to a bucket (``bkt``: a time bucket or a hash of the key). A batch writes only its own rows, as
``data/v=<2 x batch>/bkt=<b>``; what is current is named by ``manifest/v=<...>.json``, one entry per live (bucket, version)
with its number of rows and greatest time. The manifest is written after the data and appears by a rename, so a
batch becomes visible at once or not at all, and a replay of a batch starts from the manifest before it and
overwrites its own folders. Reads open the folders of the asked buckets alone and keep, per key, the row of the greatest
(version, order, row hash): the same row whatever the partitioning. A row with ``_gone`` removes its key.

Buckets that ``merge_at`` versions or more make up are merged into one version (``2 x batch + 1``), rows beyond the retention left out;
other buckets stay as they are. ``vacuum`` deletes folders that no kept manifest names. Bytes written per batch
grow with the batch, and per compaction with the touched buckets, not with the table.

The manifest has at most buckets x ``merge_at`` rows (compaction runs with every batch), so its names fit the driver.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import ntz_lit
from ..operators.sequence import bucket_of
from ..sources.paths import list_dirs, list_files, read_text, remove, write_text
from .keyed import KEYS, last_wins

BKT, GONE, ORDER, VERSION = "bkt", "_gone", "_order", "_version"


def by_time(hours: int = 168, time: str = "time") -> Callable[[], Column]:
    """Buckets of so many hours: late rows touch the buckets of their time."""
    return lambda: bucket_of(time, hours)


def by_hash(n: int = 16, *keys: str) -> Callable[[], Column]:
    """Buckets by a hash of the series key: a batch touches the buckets of its series."""
    return lambda: F.pmod(F.xxhash64(*(keys or KEYS[:1])), F.lit(n)).cast("long")


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, bucket: Callable[[], Column], keys: Sequence[str] = KEYS,
                 time: str = "time", merge_at: int = 4, retain_hours: int | None = None):
        self.spark, self.path, self.bucket = spark, path.rstrip("/"), bucket
        self.keys, self.time, self.merge_at, self.retain_hours = list(keys), time, merge_at, retain_hours
        self._schemas: dict[int, T.StructType] = {}         # of the versions that this process wrote

    # -- manifests ---------------------------------------------------------------------------------
    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest/v={version}.json"

    def _versions(self) -> list[int]:
        return sorted(int(f[2:-5]) for f in list_files(self.spark, f"{self.path}/manifest") if f.endswith(".json"))

    def entries(self, below: int | None = None) -> list[dict]:
        """{bkt, v, n, max_time} of the newest manifest (below a version)."""
        versions = [v for v in self._versions() if below is None or v < below]
        if not versions:
            return []
        held = json.loads(read_text(self.spark, self._manifest(versions[-1])))
        return [{**e, "max_time": dt.datetime.fromisoformat(e["max_time"]) if e["max_time"] else None} for e in held]

    def exists(self) -> bool:
        return bool(self._versions())

    def buckets(self) -> list[int]:
        return sorted({e[BKT] for e in self.entries()})

    def cutoff(self, hours: int | None = None) -> dt.datetime | None:
        """Greatest time of all live rows less ``hours`` (the table's own retention), from the manifest alone."""
        hours = self.retain_hours if hours is None else hours
        if hours is None:
            return None
        times = [e["max_time"] for e in self.entries() if e["max_time"] is not None]
        return max(times) - dt.timedelta(hours=hours) if times else None

    def _publish(self, version: int, kept: list[dict], fresh: DataFrame) -> list[int]:
        """Names the kept entries and the freshly written buckets as current; returns the latter."""
        new = fresh.groupBy(BKT).agg(F.count("*").alias("n"), F.max(self.time).cast("timestamp_ntz").alias("max_time")).collect()
        entries = kept + [{"bkt": int(r[BKT]), "v": version, "n": r["n"], "max_time": r["max_time"]} for r in new]
        write_text(self.spark, self._manifest(version), json.dumps(
            [{**e, "max_time": e["max_time"].isoformat() if e["max_time"] else None} for e in entries]))
        return sorted(int(r[BKT]) for r in new)

    # -- writes ------------------------------------------------------------------------------------
    def _data(self, version: int) -> str:
        return f"{self.path}/data/v={version}"

    def _write(self, rows: DataFrame, version: int) -> DataFrame:
        rows.write.mode("overwrite").partitionBy(BKT).parquet(self._data(version))
        self._schemas[version] = rows.schema
        return self.spark.read.schema(rows.schema).parquet(self._data(version))

    def append(self, rows: DataFrame, batch: int, order: str | None = None, gone: DataFrame | None = None) -> list[int]:
        """One batch: rows, and keys that go (``gone``; a row of the batch itself stays). Returns the touched buckets."""
        version = 2 * batch
        for later in [v for v in self._versions() if v >= version]:
            remove(self.spark, self._manifest(later))
        fresh = rows.withColumns({GONE: F.lit(False), ORDER: F.col(order).cast("long") if order else F.lit(0).cast("long")})
        if gone is not None:
            left = gone.select(*self.keys).distinct().join(rows.select(*self.keys).distinct(), self.keys, "left_anti")
            fresh = fresh.unionByName(left.withColumns({GONE: F.lit(True), ORDER: F.lit(0).cast("long")}), allowMissingColumns=True)
        written = self._write(fresh.withColumn(BKT, self.bucket()), version)
        touched = self._publish(version, self.entries(below=version), written)
        self.compact(batch)
        return touched

    def compact(self, batch: int) -> list[int]:
        """Merges the buckets of at least ``merge_at`` versions; rows beyond the table's retention go."""
        held: dict[int, list] = {}
        for e in self.entries():
            held.setdefault(e[BKT], []).append(e)
        many = sorted(b for b, es in held.items() if len(es) >= self.merge_at)
        if many:
            version = 2 * batch + 1
            rows = self._merged(many)
            cutoff = self.cutoff()
            if cutoff is not None:
                rows = rows.filter(F.col(self.time) >= ntz_lit(cutoff))
            written = self._write(rows, version)
            self._publish(version, [e for b, es in held.items() if b not in many for e in es], written)
        return many

    def vacuum(self, keep: int = 2) -> list[int]:
        """Deletes manifests but the newest ``keep`` and data that none of those names; returns the deleted versions."""
        versions = self._versions()
        for old in versions[:-keep]:
            remove(self.spark, self._manifest(old))
        named = {e["v"] for v in versions[-keep:] for e in self.entries(below=v + 1)}
        found = [int(d[2:]) for d in list_dirs(self.spark, f"{self.path}/data")]
        dead = sorted(v for v in found if v not in named and v < max(versions, default=0))
        for v in dead:
            remove(self.spark, self._data(v))
        return dead

    # -- reads -------------------------------------------------------------------------------------
    def _merged(self, buckets: Iterable[int] | None) -> DataFrame:
        """Live rows of the buckets with their order columns; only these buckets' folders are opened."""
        asked = None if buckets is None else set(buckets)
        by_version: dict[int, list[int]] = {}
        for e in self.entries():
            if asked is None or e[BKT] in asked:
                by_version.setdefault(e["v"], []).append(e[BKT])
        frames = []
        for v, held in sorted(by_version.items()):
            paths = [f"{self._data(v)}/{BKT}={b}" for b in sorted(held)]
            reader = self.spark.read.option("basePath", self._data(v))
            reader = reader.schema(self._schemas[v]) if v in self._schemas else reader
            frames.append(reader.parquet(*paths).withColumns({VERSION: F.lit(v).cast("long"), BKT: F.col(BKT).cast("long")}))
        if not frames:
            raise FileNotFoundError(f"no live rows in {self.path}")
        rows = frames[0]
        for f in frames[1:]:
            rows = rows.unionByName(f, allowMissingColumns=True)
        # of rows with one version and order the one with the greatest content hash: the same on every replay
        content = [c for c in rows.columns if c not in (VERSION, ORDER, GONE, BKT)]
        best = last_wins(rows.withColumn("_tie", F.xxhash64(*content)), self.keys, (VERSION, ORDER, "_tie"), drop_order=False)
        return best.filter(~F.col(GONE)).drop("_tie", VERSION)

    def read(self, buckets: Iterable[int] | None = None, hours: int | None = None) -> DataFrame:
        """Current rows (of the named buckets) within ``hours`` or the table's own retention (K4)."""
        rows = self._merged(buckets).drop(GONE, ORDER, BKT)
        cutoff = self.cutoff(hours)
        return rows if cutoff is None else rows.filter(F.col(self.time) >= ntz_lit(cutoff))

    def counts(self, key: str = "city") -> DataFrame:
        """(key, bkt, n): rows per series and bucket, from the key columns alone."""
        return self._merged(None).groupBy(key, BKT).agg(F.count("*").alias("n"))
