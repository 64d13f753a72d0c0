"""Shared helpers of the text operators: inputs, checked broadcasts, text batches and connected components."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smogline.session import cut_lineage, scratch_path

#: A side of a join is broadcast below this many rows (narrow rows only); otherwise the planner shuffles it.
BROADCAST_ROWS = 2_000_000


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors once a context, so that tasks import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_smogline_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="smogline-"), "smogline_llm.zip")   # read by the driver alone
    with zipfile.ZipFile(path, "w") as z:
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                z.write(os.path.join(here, name), f"smogline/llm/{name}")
        for name in ("__init__.py", "session.py"):
            z.write(os.path.join(here, "..", name), f"smogline/{name}")
    sc.addPyFile(path)
    sc._smogline_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A driver table with only the named columns (all when none is named)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of an id written as text, modulo ``m`` (null for a null id)."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(m)


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a narrow table for broadcast after counting it; past the bound the planner joins by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that does not clash with the table's own."""
    name = base
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def text_chunks(texts: list[str], size: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Groups of (document positions, texts) with about ``size`` code points in each."""
    at, held, total = [], [], 0
    for i, t in enumerate(texts):
        at.append(i)
        held.append(t)
        total += len(t)
        if total >= size:
            yield np.array(at), held
            at, held, total = [], [], 0
    if at:
        yield np.array(at), held


def code_points(text: str) -> np.ndarray:
    """Code points as uint32 (lone surrogates kept)."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (a bijection of 64-bit words)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ranges(first: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ..., then first[1], ... (lens[i] numbers of each)."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(first - (ends - lens), lens)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` has columns ``a`` and ``b`` of one orderable type; returns (node, root) with root the least
    node of the component. Every round is two aggregations with joins, written under the shared folder;
    neither links nor components come to the driver (only a row count and a checksum per round).
    """
    cur = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .distinct(), "cc")
    state = None
    for _ in range(max_rounds):
        both = cur.unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours of a go to the least of a's neighbourhood
        large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        # small star: smaller neighbours of a, and a itself, go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a")
                 .select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                          F.struct(F.col("a").alias("a"), F.col("m").alias("b")))))
                 .where("a <> b").distinct())
        cur = cut_lineage(small, "cc")
        new = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


__all__ = ["BROADCAST_ROWS", "checked_broadcast", "code_points", "components", "crc_mod", "cut_lineage", "fresh_name",
           "mix64", "partitions_of", "ranges", "scratch_path", "ship", "table", "text_chunks"]
