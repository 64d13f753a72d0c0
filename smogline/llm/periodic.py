"""Periodic run detection: overlapping tiles a period octave, solved alone, stitched by (document, period).

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least
``max(MIN_LENGTH, REPEATS * q)`` words that no neighbouring word extends. As words q apart are equal on a run, a run is
an interval of places i with w[i] = w[i + q], its *link interval*, of at least (REPEATS - 1) * q places.

Periods fall in octaves: 1 to 7, then P to 2P - 1 for P = 8, 16, ... In an octave, anchors stand every A words
(3, then 3P/2), so close that every link interval holds an anchor c with its whole window [c, c + A). A tile is the
words that the anchors of one block need: A before, 2A + 2P after. Only anchors whose window occurs again P to 2P - 1 words later (rolling
hashes of the whole batch; never misses one) become tiles, so text without repeats is neither copied nor shuffled.

A tile is solved from its words alone: at every anchor the Z-function to the right and the one of the reversed words
to the left give, for all periods of the octave, how far the links reach, up to the neighbouring anchors. Periods that
are multiples of a smaller one at the anchor are dropped (all windows of a run are rotations of one another, so every
anchor of a run decides alike). Fragments of links are shuffled by (document, period), where touching ones become
one run. Nothing depends on the length of a document: a long one is many tiles in many tasks.

Defined cases: null and blank texts have no words, no runs and the sha256 of the empty string; null ids are rows like
others (the periodic edit of the query leaves them alone); repeated rows and ids each return their own row; other columns of
the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, mix64, table, text_chunks

#: A run has at least so many words, and at least so many periods.
MIN_LENGTH, REPEATS = 6, 4
#: The first octave (periods 1 to 7) has anchors every third word: its shortest link interval is 5 places.
FIRST, FIRST_STEP = 8, 3
#: Anchors within so many words share a tile.
BLOCK_WORDS = 1536
#: Code points of text per vectorised batch, and cells of a comparison.
BATCH_CHARS, CELLS = 3_000_000, 4_000_000
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = np.uint64(0x9E3779B97F4A7C15)

PARTS = T.StructType([T.StructField(n, t) for n, t in (
    ("tile", T.BooleanType()), ("uid", T.LongType()), ("id", T.LongType()), ("n_words", T.LongType()),
    ("text", T.StringType()), ("plain_sha256", T.StringType()), ("low", T.IntegerType()), ("high", T.IntegerType()),
    ("at", T.LongType()), ("anchors", T.BinaryType()), ("words", T.BinaryType()))])
PARTS_ARROW = pa.schema([("tile", pa.bool_()), ("uid", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()),
                         ("text", pa.string()), ("plain_sha256", pa.string()), ("low", pa.int32()),
                         ("high", pa.int32()), ("at", pa.int64()), ("anchors", pa.binary()), ("words", pa.binary())])
FRAGMENTS = T.StructType([T.StructField(n, T.LongType()) for n in ("uid", "period", "lo", "hi")])
FRAGMENTS_ARROW = pa.schema([(n, pa.int64()) for n in ("uid", "period", "lo", "hi")])


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def octaves(longest: int) -> Iterator[tuple[int, int, int]]:
    """(least period, first period beyond, step of the anchors) of all octaves that a text of so many words can have."""
    if longest >= MIN_LENGTH:
        yield 1, FIRST, FIRST_STEP
    low = FIRST
    while REPEATS * low <= longest:
        yield low, 2 * low, 3 * low // 2
        low *= 2


def edited(words: list[str], key: int | None) -> list[str]:
    """The words after the query's edit: documents with h % 10 = 0 become periodic from word a on."""
    n = len(words)
    if key is None or not n:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[:n - a]


def window_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial of the codes and its powers (mod 2^64)."""
    power = np.full(len(codes) + 1, ODD, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(mix64(codes.astype(np.uint64) + ODD) * power[:-1], out=sums[1:])
    return sums, power


def repeated_anchors(sums: np.ndarray, power: np.ndarray, total: int, low: int, high: int, step: int) -> np.ndarray:
    """Anchors (multiples of ``step``) below ``total`` whose window of ``step`` words occurs again low to high - 1 later."""
    places = total - step + 1
    if places <= low:
        return np.zeros(0, dtype=np.int64)
    hashes = np.zeros(places + high, dtype=np.uint64)
    hashes[:places] = (sums[step:total + 1] - sums[:places]) * power[len(power) - 1 - np.arange(places)]
    anchors = np.arange(0, places - low, step)
    hit = np.zeros(len(anchors), dtype=bool)
    rows = max(1, CELLS // (high - low))
    for i in range(0, len(anchors), rows):
        part = anchors[i:i + rows]
        near = np.lib.stride_tricks.as_strided(hashes[part[0] + low:], (len(part), high - low), (8 * step, 8))
        hit[i:i + rows] = (near == hashes[part][:, None]).any(axis=1)
    return anchors[hit]


def tiles(codes: np.ndarray, first: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
    """Tiles of concatenated texts, the longest first: (text, low, high, place of the tile, anchors in it, words)."""
    sums, power = window_hashes(codes)
    for low, high, step in octaves(int(n[0]) if len(n) else 0):
        held = int(np.searchsorted(-n, -max(MIN_LENGTH, REPEATS * low), side="right"))
        total = int(first[held - 1] + n[held - 1])
        anchors = repeated_anchors(sums, power, total, low, high, step)
        if not len(anchors):
            continue
        text = np.searchsorted(first[:held], anchors, side="right") - 1
        inside = anchors + low + step <= first[text] + n[text]
        anchors, text = anchors[inside], text[inside]
        block = (anchors - first[text]) // max(BLOCK_WORDS, step)
        cuts = np.flatnonzero((np.diff(text) != 0) | (np.diff(block) != 0)) + 1
        for group in np.split(np.arange(len(anchors)), cuts):
            if len(group):
                t = int(text[group[0]])
                begin = max(int(first[t]), int(anchors[group[0]]) - step)
                end = min(int(first[t] + n[t]), int(anchors[group[-1]]) + 2 * step + high)
                yield t, low, high, begin - int(first[t]), anchors[group] - begin, codes[begin:end]


def z_function(s: list) -> list[int]:
    """z[i]: letters from i on that equal the beginning (z[0] left 0)."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


@lru_cache(maxsize=65536)
def inner_periods(q: int) -> tuple[int, ...]:
    """q / p for the primes p that divide q: a window of q words is a power only if one of them is its period."""
    found, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            found.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    if rest > 1:
        found.append(q // rest)
    return tuple(found)


def solve_tile(words: np.ndarray, anchors: np.ndarray, low: int, high: int) -> dict[int, list[list[int]]]:
    """Link intervals [lo, hi) in the tile by period, touching ones merged; each holds some anchor's whole window."""
    step = FIRST_STEP if low < FIRST else 3 * low // 2
    w = words.tolist()
    found: dict[int, list[list[int]]] = {}
    for c in anchors.tolist():
        right = z_function(w[c:c + 2 * step + high])
        reach = np.array(right[low:high])
        periods = np.flatnonzero(reach >= step) + low
        if not len(periods):
            continue
        before = w[max(0, c - step):c][::-1]
        tail = w[max(0, c - step):c + high][::-1]
        left = z_function(before + [-1] + tail)
        shift = 1 + len(tail)                                      # left[shift - q]: links before the anchor
        for q in periods.tolist():
            if any(right[d] >= q - d for d in inner_periods(q) if d < q):
                continue
            lo, hi = c - left[shift - q], c + min(right[q], 2 * step)
            held = found.setdefault(q, [])
            if held and lo <= held[-1][1]:
                held[-1][1] = max(held[-1][1], hi)
            else:
                held.append([lo, hi])
    return found


def split_texts(batches: Iterator[pa.RecordBatch], edit: bool) -> Iterator[pa.RecordBatch]:
    """Documents to tiles, and one row a document: whole (no tile) or with its words, to be finished later."""
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for at, texts in text_chunks([t or "" for t in batch.column(1).to_pylist()], BATCH_CHARS):
            keys = [ids[i] for i in at]
            words = [WORDS.findall(t) for t in texts]
            if edit:
                words = [edited(w, k) for w, k in zip(words, keys)]
            order = sorted(range(len(words)), key=lambda i: -len(words[i]))
            number: dict[str, int] = defaultdict(count().__next__)
            codes = np.fromiter(map(number.__getitem__, chain.from_iterable(words[i] for i in order)), dtype=np.int32)
            n = np.array([len(words[i]) for i in order], dtype=np.int64)
            first = np.cumsum(n) - n
            out = {name: [] for name in PARTS_ARROW.names}
            tiled = set()

            def put(**values):
                for name, held in out.items():
                    held.append(values.get(name))

            for t, low, high, place, anchors, tile in tiles(codes, first, n):
                tiled.add(order[t])
                put(tile=True, uid=row + order[t], low=low, high=high, at=place,
                    anchors=anchors.astype(np.int32).tobytes(), words=tile.tobytes())
            for i, held in enumerate(words):
                text = " ".join(held)
                put(tile=False, uid=row + i, id=keys[i], n_words=len(held), text=text if i in tiled else None,
                    plain_sha256=sha(text))
            row += len(words)
            yield pa.RecordBatch.from_pydict(out, schema=PARTS_ARROW)


def solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], [], [], []]
        for uid, low, high, at, anchors, words in zip(*(c.to_pylist() for c in batch.columns)):
            found = solve_tile(np.frombuffer(words, np.int32), np.frombuffer(anchors, np.int32), low, high)
            for q, held in found.items():
                for lo, hi in held:
                    for column, value in zip(out, (uid, q, at + lo, at + hi)):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=FRAGMENTS_ARROW)


def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of the words that no run drops: (uid, text, runs) to (uid, sha)."""
    schema = pa.schema([("uid", pa.int64()), ("sha", pa.string())])
    for batch in batches:
        uids, texts, runs = (c.to_pylist() for c in batch.columns)
        shas = []
        for text, held in zip(texts, runs):
            words = text.split(" ")
            change = np.zeros(len(words) + 1, dtype=np.int64)
            for r in held or ():
                change[r["start"] + r["period"]] += 1
                change[r["start"] + r["length"]] -= 1
            shas.append(sha(" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])))
        yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(shas, pa.string())], schema=schema)


def stitch(fragments: DataFrame) -> DataFrame:
    """Runs (uid, period, start, length) of link fragments: touching ones of a document and period become one."""
    by = Window.partitionBy("uid", "period").orderBy("lo", "hi")
    before = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before >= F.col("lo"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    whole = (fragments.withColumn("island", island).groupBy("uid", "period", "island")
             .agg(F.min("lo").alias("start"), (F.max("hi") - F.min("lo") + F.col("period")).alias("length")))
    return whole.where(F.col("length") >= F.greatest(F.lit(MIN_LENGTH), REPEATS * F.col("period"))).drop("island")


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: bool = False) -> DataFrame:
    """Documents and tiles as one written table, so that later steps see the same row numbers after a lost executor."""
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return cut_lineage(chosen.mapInArrow(lambda batches: split_texts(batches, edit), PARTS), "run-parts")


def runs_of(split: DataFrame) -> DataFrame:
    """All runs (uid, period, start, length) of the documents in ``parts``."""
    todo = split.where("tile").select("uid", "low", "high", "at", "anchors", "words").repartition("uid", "low", "at")
    return stitch(todo.mapInArrow(solve_tiles, FRAGMENTS))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, period) of every run of every text, in words."""
    split = parts(docs, id_col, text_col)
    return (split.where("not tile").select("uid", F.col("id").alias(id_col)).join(runs_of(split), "uid")
            .select(id_col, "start", "length", "period"))


def digest(docs: DataFrame, edit: bool = True) -> DataFrame:
    """One row a document: its number of runs, the longest, digests of all runs and of the text without repeats."""
    split = parts(docs, edit=edit)
    by_doc = (runs_of(split).groupBy("uid")
              .agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs")))
    # sorted by start, then length; of one start the longer run has another period, so order again by period
    by_doc = cut_lineage(by_doc.select("uid", F.expr(
        "array_sort(runs, (a, b) -> CASE WHEN a.start <> b.start THEN CASE WHEN a.start < b.start THEN -1 ELSE 1 END "
        "WHEN a.period < b.period THEN -1 WHEN a.period > b.period THEN 1 ELSE 0 END)").alias("runs")), "runs")
    whole = split.where("not tile")
    kept = (whole.where("text IS NOT NULL").select("uid", "text").join(by_doc, "uid")
            .mapInArrow(collapse, "uid long, sha string"))
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    return (whole.select("uid", "id", "n_words", "plain_sha256").join(by_doc, "uid", "left").join(kept, "uid", "left")
            .withColumn("best", best)
            .select(F.col("id").alias("doc_id"),
                    F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"),
                    (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
                    (-F.col("best.period")).alias("period"),
                    F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
                    F.sha2(F.coalesce(lines, F.lit("")).cast("binary"), 256).alias("runs_sha256"),
                    F.coalesce("sha", "plain_sha256").alias("collapsed_sha256"), "n_words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents", "doc_id", "text"))
