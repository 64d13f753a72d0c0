"""SimHash near-duplicates: generalised pigeonhole over groups of correlated bits.

Fingerprint: words are runs of anything but blanks (A-Z lower-cased), shingles are three words joined by
one blank (the whole sequence when there are fewer; none: fingerprint 0); bit k is 1 when it is set in more
than half of the shingles' XXH64 values (repeats count).

Search: the 64 bits are grouped into parts of correlated bits and each part gets its own threshold t_i >= -1
with sum(t_i + 1) = distance + 1, so two fingerprints within ``distance`` agree in some part up to its
threshold (-1: the part is not indexed). A dynamic programme picks the thresholds with the least estimated
number of candidates. Every distinct fingerprint is indexed once a part and probed with all values within the
threshold, candidates are verified by the number of differing bits.

Buckets with more than ``bucket_rows`` fingerprints would give pairs by the square. Their members are linked
by common neighbours instead: two values within 2r bits have a common value within r bits of both, and all
that share one are linked, so a star over each such value gives the same components without pairs (odd
distances: r bits on one side, r + 1 on the other). This is exact, nothing is capped.

Defined results: null and blank texts have fingerprint 0 and link to each other; equal texts share a
fingerprint; rows with a null doc_id keep a fingerprint, and join the component that the others of that
fingerprint are in (null if there is none); repeated doc_ids are kept as they are.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut_lineage, fresh_name, table

SHINGLE = 3
DISTANCE = 2
BITS = 64
SEED = 42
BUCKET_ROWS = 48
SAMPLE = 4096
SPACES = re.compile(r"[\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, in order."""
    flat = SPACES.sub(" ", (text or "").translate(LOWER)).strip(" ").encode("utf-8", "surrogatepass")
    if not flat:
        return np.zeros(0, dtype=np.uint64)
    blanks = np.flatnonzero(np.frombuffer(flat, dtype=np.uint8) == 32)
    first = np.concatenate([[0], blanks + 1])
    last = np.append(blanks, len(flat))
    h = xxhash.xxh64_intdigest
    if len(first) <= width:
        return np.array([h(flat, SEED)], dtype=np.uint64)
    a, b = first[:len(first) - width + 1].tolist(), last[width - 1:].tolist()
    return np.fromiter((h(flat[i:j], SEED) for i, j in zip(a, b)), dtype=np.uint64, count=len(a))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    h = shingle_hashes(text, width)
    if not len(h):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        # sums of 255 rows at most fit a byte, so the bulk of the additions run on bytes
        bits = np.unpackbits(part, axis=1, bitorder="little")
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint_udf(width: int = SHINGLE):
    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, width) for t in text), dtype=np.uint64, count=len(text))
                         .view(np.int64))

    return fp


def correlated_parts(sample: np.ndarray, n_parts: int) -> list[list[int]]:
    """Groups the 64 bits into parts of nearly equal size; each part gathers bits that correlate most."""
    bits = (((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
            if len(sample) else np.zeros((1, BITS)))
    dev = bits.std(0)
    c = np.abs(((bits - bits.mean(0)).T @ (bits - bits.mean(0))) / len(bits)) / np.maximum(np.outer(dev, dev), 1e-9)
    left, parts = list(range(BITS)), []
    for k in range(n_parts):
        size = BITS * (k + 1) // n_parts - BITS * k // n_parts
        group = [min(left)]
        left.remove(group[0])
        while len(group) < size:
            nxt = max(left, key=lambda b: (c[b, group].sum(), -b))
            group.append(nxt)
            left.remove(nxt)
        parts.append(sorted(group))
    return parts


def part_values(x: np.ndarray, bits: list[int]) -> np.ndarray:
    mask = np.uint64(sum(1 << b for b in bits))
    return x & mask


def estimated_candidates(sample: np.ndarray, bits: list[int], threshold: int) -> float:
    """Probe cost and expected sample partners that agree in ``bits`` up to ``threshold`` differing bits."""
    if threshold < 0:
        return 0.0
    v, n = np.unique(part_values(sample, bits), return_counts=True)
    rng = np.random.default_rng(0)
    pick = rng.choice(len(v), size=min(len(v), 256), replace=False) if len(v) else []
    near = sum(float(n[i] * n[np.bitwise_count(v ^ v[i]) <= threshold].sum()) for i in pick)
    probes = sum(len(list(combinations(range(len(bits)), k))) for k in range(threshold + 1))
    return near * len(v) / max(len(pick), 1) + probes * max(len(sample), 1)


def allocate(sample: np.ndarray, parts: list[list[int]], distance: int) -> list[int]:
    """Thresholds with sum(t + 1) = distance + 1 and the least estimated cost (dynamic programme over parts)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in parts:
        costs = [estimated_candidates(sample, bits, t) for t in range(-1, distance + 1)]
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, distance + 1 - used):
                cand = (cost + costs[t + 1], ts + [t])
                if used + t + 1 not in nxt or cand < nxt[used + t + 1]:
                    nxt[used + t + 1] = cand
        best = nxt
    return best[distance + 1][1]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def flips(bits: list[int], radius: int) -> list[int]:
    """Masks with at most ``radius`` of the bits set, as signed 64-bit numbers."""
    return [signed(sum(1 << b for b in some)) for k in range(radius + 1) for some in combinations(bits, k)]


def exploded(df: DataFrame, masks: list[int], name: str, value) -> DataFrame:
    return df.withColumn("m_", F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))).withColumn(
        name, value.bitwiseXOR(F.col("m_"))).drop("m_")


def links(fps: DataFrame, distance: int = DISTANCE, n_parts: int | None = None,
          bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) of distinct fingerprints (column ``fp``) whose components are those of all pairs within
    ``distance`` bits."""
    if distance == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    n_parts = n_parts or distance + 1
    # a bounded sample chooses parts and thresholds; every fingerprint is indexed
    sample = np.array([r["fp"] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()],
                      dtype=np.int64).view(np.uint64)
    parts = correlated_parts(sample, n_parts)
    thresholds = allocate(sample, parts, distance)
    used = [(i, bits, t) for i, (bits, t) in enumerate(zip(parts, thresholds)) if t >= 0]
    masks = {i: signed(sum(1 << b for b in bits)) for i, bits, _ in used}
    index = reduce(DataFrame.unionAll, [
        fps.select(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(masks[i]).cast("long")).alias("key"), "fp")
        for i, _, _ in used])
    size = index.groupBy("part", "key").agg(F.count("*").alias("n"))
    sized = cut_lineage(index.join(size, ["part", "key"]), "simhash-index")
    cold, hot = sized.where(F.col("n") <= bucket_rows), sized.where(F.col("n") > bucket_rows)
    # probe: every fingerprint asks for all values within the part's threshold; hot buckets answer elsewhere
    probe = reduce(DataFrame.unionAll, [
        exploded(fps.select(F.lit(i).alias("part"), F.col("fp").alias("q")), flips(bits, t), "key",
                 F.col("q").bitwiseAND(F.lit(masks[i]).cast("long"))) for i, bits, t in used])
    pairs = (probe.join(cold, ["part", "key"])
             .where((F.col("q") < F.col("fp")) & (F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= distance))
             .select(F.col("q").alias("a"), F.col("fp").alias("b")))
    # hot buckets: members, and the probes that would meet them, by common neighbours over all 64 bits.
    # A probe that is itself in no hot bucket meets them through the same keys.
    asked = probe.join(hot.select("part", "key").distinct(), ["part", "key"], "left_semi").select(F.col("q").alias("fp"))
    dense = cut_lineage(hot.select("fp").unionAll(asked).distinct(), "simhash-hot")
    if not dense.limit(1).count():
        return pairs
    r, every = distance // 2, list(range(BITS))
    near = exploded(dense, flips(every, r), "mid", F.col("fp"))
    star = near.groupBy("mid").agg(F.min("fp").alias("b"))
    stars = near.join(star, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b")
    if distance % 2:
        outer = exploded(dense, flips(every, r + 1), "mid", F.col("fp"))
        stars = stars.unionAll(outer.join(star, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b"))
    return pairs.unionAll(stars)


def classes(fps: DataFrame, distance: int = DISTANCE, **how) -> DataFrame:
    """(fp, root): the component of every distinct fingerprint that has a link; others are left out."""
    found = links(fps, distance, **how)
    return components(found).withColumnsRenamed({"node": "fp"})


def with_components(docs: DataFrame, width: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text)."""
    rows = cut_lineage(docs.select("doc_id", fingerprint_udf(width)(F.col("text")).alias("fp")), "simhash-fp")
    least = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("doc")), "simhash-distinct")
    cls = least.join(classes(least.select("fp"), distance), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "doc")
    ids = cls.groupBy("root").agg(F.min("doc").alias("component_id"))
    of = cut_lineage(cls.join(ids, "root").select("fp", "component_id"), "simhash-classes")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The documents without those that are not the least doc_id of their component (same columns). Rows with
    a null doc_id and repeats of a kept doc_id cannot be told apart by id and stay."""
    name = fresh_name(docs, "doc_id_gone")
    gone = with_components(docs, width, distance).where("doc_id <> component_id").select(
        F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document."""
    out = with_components(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
