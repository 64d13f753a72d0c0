"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line that is not blank) hashes to a wide vector of two blocks, and the fingerprint of a text is
the sum of its paragraphs' vectors, each lane modulo a power of two:

* ``WIDE`` lanes of 64 bits from SHAKE-128 of the whole paragraph: equal sums mean equal multisets;
* ``LIKE`` lanes of 16 bits, the sum of +1/-1 vectors of the paragraph's pieces of four words: the squared
  distance of two such sums estimates how many pieces differ, hence a likeness from 0 to 1.

Sums are order-independent, and paragraphs can be inserted or deleted by adding or subtracting their vectors
(``insert``, ``delete``) without the rest of the text.

Defined results: null is the empty text; texts without paragraphs have the zero vector and likeness 1 to each
other; rows with equal doc_id are ordered by their text; null doc_ids come last in the descending order; the
successor of the last row is the first (of a single row: itself).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions_of, table

WIDE = 16
LIKE = 128
PIECE_WORDS = 4
CHUNK = 1 << 18


def paragraphs(text: str) -> list[str]:
    return [p for p in text.split("\n") if p.strip()]


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n x WIDE uint64, n x LIKE int16): the fingerprints of many texts."""
    wide = np.zeros((len(texts), WIDE), dtype=np.uint64)
    like = np.zeros((len(texts), LIKE), dtype=np.int16)
    held: list[bytes] = []
    of: list[int] = []

    def flush() -> None:
        if held:
            bits = np.unpackbits(np.frombuffer(b"".join(held), dtype=np.uint8).reshape(len(held), LIKE // 8), axis=1)
            at = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1])
            n = np.diff(np.append(at, len(of))).astype(np.int64)
            # lanes are +1/-1: twice the ones less the number of pieces, modulo 2^16
            ones = np.add.reduceat(bits, at, axis=0, dtype=np.uint16)
            like[np.array(of)[at]] += (2 * ones - n[:, None].astype(np.uint16)).view(np.int16)
            held.clear()
            of.clear()

    digest = xxhash.xxh3_128_digest
    for i, text in enumerate(texts):
        ps = paragraphs(text)
        if not ps:
            continue
        raw = b"".join([hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(8 * WIDE) for p in ps])
        wide[i] = np.frombuffer(raw, dtype="<u8").reshape(len(ps), WIDE).sum(0, dtype=np.uint64)
        for p in ps:
            w = p.split()
            held += [digest(" ".join(w[k:k + PIECE_WORDS]).encode("utf-8", "surrogatepass"))
                     for k in range(0, len(w), PIECE_WORDS)]
            of += [i] * (len(held) - len(of))
            if len(held) >= 1 << 14:
                flush()
    flush()
    return wide, like


def insert(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of the union of both multisets of paragraphs."""
    return a[0] + b[0], a[1] + b[1]


def delete(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of ``a`` without the paragraphs of ``b``."""
    return a[0] - b[0], a[1] - b[1]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Row by row: 1 - |a - b|^2 / (|a|^2 + |b|^2), within 0 and 1; 1 for equal fingerprints."""
    diff = (a[1] - b[1]).astype(np.float64)
    norm = (a[1].astype(np.float64) ** 2).sum(1) + (b[1].astype(np.float64) ** 2).sum(1)
    near = np.clip(1.0 - (diff ** 2).sum(1) / np.maximum(norm, 1e-9), 0.0, 1.0)
    return np.where((a[0] == b[0]).all(1), 1.0, near)


def texts_of(v: tuple[np.ndarray, np.ndarray]) -> list[str]:
    raw_wide, raw_like = v[0].astype("<u8"), v[1].astype("<i2")
    return [base64.b64encode(w.tobytes() + s.tobytes()).decode() for w, s in zip(raw_wide, raw_like)]


def edited_text(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_successor(docs: DataFrame) -> DataFrame:
    """(pid, doc_id, t, halo) so that each row's successor in descending doc_id order is the next row of its pid.

    Rows are cut into ranges of doc_id by approximate percentiles; every range also receives the first row of
    the next one (``halo``), so no order over all rows is built. Only range bounds and first ids, one a
    partition, come to the driver.
    """
    spark = docs.sparkSession
    n = max(partitions_of(spark), 1)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000).alias("q")).first()["q"]
    bounds = sorted(set(cuts or []))
    if bounds:
        ends = np.array(bounds)

        @F.pandas_udf("int")
        def below(ids: pd.Series) -> pd.Series:
            # descending ranges: the number of bounds above the id; null ids come last
            return pd.Series(len(ends) - np.searchsorted(ends, ids.to_numpy(), side="right"), dtype="int32")

        rows = rows.withColumn("pid", F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(
            below(F.coalesce("doc_id", F.lit(bounds[0])))))
    else:
        rows = rows.withColumn("pid", F.lit(0))
    first = {r["pid"]: r["d"] for r in rows.groupBy("pid").agg(F.max("doc_id").alias("d")).collect()}
    if not first:
        return rows.withColumn("halo", F.lit(0))
    order = sorted(first)
    # the first row of range order[i] goes to the range before it (cyclic)
    move = spark.createDataFrame([(p, first[p], order[i - 1]) for i, p in enumerate(order)],
                                 f"pid int, doc_id {dict(rows.dtypes)['doc_id']}, target int")
    move = F.broadcast(move)  # one row a partition
    halo = (rows.join(move, (rows.pid == move.pid) & rows.doc_id.eqNullSafe(move.doc_id))
            .groupBy(move.target, move.doc_id).agg(F.min(rows.t).alias("t"))
            .select("doc_id", "t", F.col("target").alias("pid"), F.lit(1).alias("halo")))
    both = rows.withColumn("halo", F.lit(0)).unionByName(halo)
    return (both.repartitionById(max(order) + 1, F.col("pid"))
            .sortWithinPartitions("pid", "halo", F.col("doc_id").desc_nulls_last(), "t"))


def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One output row for each pair of neighbouring rows; holds one row and one batch."""
    pending = None
    for pdf in batches:
        got = list(zip(pdf.doc_id, pdf.t, pdf.halo))
        if pending is not None:
            got.insert(0, pending)
        lo = 0
        while lo < len(got) - 1:
            hi, size = lo + 1, len(got[lo][1])
            while hi < len(got) - 1 and size < CHUNK * 8:
                size += len(got[hi][1])
                hi += 1
            part = got[lo:hi + 1]
            own = vectors([t for _, t, _ in part])
            live = [k for k in range(len(part) - 1) if not part[k][2]]
            if live:
                edits = [edited_text(part[k][1], part[k + 1][1]) for k in live]
                a = own[0][live], own[1][live]
                nxt = [k + 1 for k in live]
                b = own[0][nxt], own[1][nxt]
                e = vectors(edits)
                yield pd.DataFrame({
                    "doc_id": [part[k][0] for k in live],
                    "n_chars": [len(part[k][1]) for k in live],
                    "edited_sha256": [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edits],
                    "fingerprint": texts_of(a), "edited_fingerprint": texts_of(e),
                    "near_edited": likeness(a, e), "near_next": likeness(a, b)})
            lo = hi
        pending = got[-1] if got else None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    laid = with_successor(docs)
    kind = dict(docs.dtypes)["doc_id"]
    # ids travel as text: pandas has no null among whole numbers
    out = laid.select(F.col("doc_id").cast("string").alias("doc_id"), "t", "halo").mapInPandas(
        follow, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                "near_edited double, near_next double")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


__all__ = ["delete", "edited_text", "fingerprints", "insert", "likeness", "paragraphs", "query", "vectors"]
