"""Outbox ledger for publishing (K7, S8): what each sink still has to get, retried until it has it.

``enqueue`` stores a batch once (``payload/batch=<id>``) and names its sinks in ``ledger/batch=<id>``; a batch without its
ledger entry was never enqueued, so a crash between the two leaves nothing half done, and a replay overwrites both. ``drain``
offers every pending (batch, sink) to the sink, batches in order; each attempt is a file of its own under ``attempts``, and a
sink that fails stops for this run (so that a sink sees batches in order) while the others go on. A required sink's failure is raised
after the others had their turn. Sinks get (rows, batch id) and write by batch id, so a delivery that is repeated because a
crash lost its mark overwrites itself: every batch arrives once in effect.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.paths import exists, list_dirs, remove

LEDGER = "batch long, sink string, required boolean"
ATTEMPTS = "batch long, sink string, ok boolean, error string, at timestamp"
Sink = Callable[[DataFrame, int], None]


def folder_sink(root: str, fmt: str = "parquet") -> Sink:
    """Writes each batch to its own folder, which a repeated delivery overwrites."""
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").format(fmt).option("header", True).save(f"{root}/delivered={batch}")
    return write


class PublishError(RuntimeError):
    """A required sink failed; what it missed stays pending."""


class Outbox:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _payload(self, batch: int) -> str:
        return f"{self.path}/payload/batch={batch}"

    def enqueue(self, rows: DataFrame, batch: int, sinks: Iterable[str], required: Iterable[str] = ()) -> None:
        """Stores a batch and what it is for. A batch that was enqueued before is replaced and offered again."""
        must = set(required)
        rows.write.mode("overwrite").parquet(self._payload(batch))
        if exists(self.spark, f"{self.path}/attempts/batch={batch}"):
            remove(self.spark, f"{self.path}/attempts/batch={batch}")
        entries = self.spark.createDataFrame([(batch, s, s in must) for s in sinks], LEDGER)
        entries.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/b={batch}")

    def ledger(self) -> DataFrame:
        """(batch, sink, required, status, attempts, error) of everything ever enqueued."""
        whole = [d for d in list_dirs(self.spark, f"{self.path}/ledger") if exists(self.spark, f"{self.path}/ledger/{d}/_SUCCESS")]
        entries = (self.spark.read.schema(LEDGER).parquet(*[f"{self.path}/ledger/{d}" for d in whole]) if whole
                   else self.spark.createDataFrame([], LEDGER))
        tried = [f"{self.path}/attempts/{d}/*" for d in list_dirs(self.spark, f"{self.path}/attempts")]
        tries = self.spark.read.schema(ATTEMPTS).parquet(*tried) if tried else self.spark.createDataFrame([], ATTEMPTS)
        state = tries.groupBy("batch", "sink").agg(
            F.max("ok").alias("ok"), F.count("*").alias("attempts"), F.max_by("error", "at").alias("error"))
        return entries.join(state, ["batch", "sink"], "left").select(
            "batch", "sink", "required", F.when(F.col("ok"), "delivered").otherwise("pending").alias("status"),
            F.coalesce("attempts", F.lit(0)).alias("attempts"), F.when(~F.coalesce("ok", F.lit(False)), F.col("error")).alias("error"))

    def pending(self) -> list:
        return self.ledger().filter("status = 'pending'").orderBy("batch", "sink").collect()

    def _mark(self, batch: int, sink: str, ok: bool, error: str | None) -> None:
        row = self.spark.createDataFrame([(batch, sink, ok, error)], "batch long, sink string, ok boolean, error string")
        (row.withColumn("at", F.current_timestamp()).coalesce(1).write
         .parquet(f"{self.path}/attempts/batch={batch}/{uuid.uuid4().hex}"))

    def drain(self, sinks: Mapping[str, Sink]) -> dict[tuple[int, str], str | None]:
        """Offers what is pending to the given sinks. Returns {(batch, sink): error or None}; raises PublishError if a required
        sink failed, after all had their turn."""
        done: dict[tuple[int, str], str | None] = {}
        stopped, broken = set(), []
        for entry in self.pending():
            batch, sink = entry["batch"], entry["sink"]
            if sink not in sinks or sink in stopped:
                continue
            try:
                sinks[sink](self.spark.read.parquet(self._payload(batch)), batch)
                error = None
            except Exception as e:  # noqa: BLE001 - any failure of a sink is recorded and retried by a later run
                error = repr(e)[:2000]
                stopped.add(sink)
                if entry["required"]:
                    broken.append((batch, sink, error))
            self._mark(batch, sink, error is None, error)
            done[(batch, sink)] = error
        if broken:
            raise PublishError(f"required sinks failed: {broken}")
        return done

    def trim(self) -> list[int]:
        """Deletes the payload of batches that all their sinks have; the ledger keeps its entries."""
        left = {r["batch"] for r in self.pending()}
        held = [int(d.split("=", 1)[1]) for d in list_dirs(self.spark, f"{self.path}/payload") if d.startswith("batch=")]
        gone = sorted(b for b in held if b not in left and exists(self.spark, f"{self.path}/ledger/b={b}/_SUCCESS"))
        for b in gone:
            remove(self.spark, self._payload(b))
        return gone
