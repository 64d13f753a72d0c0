"""Exponentially weighted mean per series (W6) without a Python loop or a per-series task.

Semantics (adjusted weights, nulls keep their place): at a row with a value,
ewma_t = sum_j r^(t-j) x_j / sum_j r^(t-j) over earlier rows j with a value, r = 1 - alpha,
alpha = 2 / (span + 1); a row without a value repeats the last value; leading rows without any value
stay null.

Plan, inside the chunked series window of ``sequence.over_series`` (one shuffle, shared with the other
training windows), with a halo of ``halo_rows(span)`` rows (256 for span 6) before each chunk:

1. running sums U = sum x_j r^-q_j and V = sum r^-q_j over the rows of the window partition up to the
   current one, with q = position minus the middle of the partition (so r^-q stays within about
   1e+-150); ewma = U / V (the factor r^q_t cancels). Every home row has at least the halo as history
   in its partition (or the true series start), so dropped terms weigh below r^256 ~ 1e-37 relative to
   the current one;
2. a home row whose last value lies before its chunk (a null run over the chunk start) takes the value
   of the last earlier row with a value instead: per-chunk last values (one row per chunk), an
   exclusive prefix scan over them, joined only to the rows that need it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sequence import CHUNK, HOME, exclusive_scan

EWMA_HALO = 256


def _ratio(span: float) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def halo_rows(span: float, rel: float = 1e-37) -> int:
    """Rows of history after which older weights fall below ``rel`` (256 for span 6)."""
    r = _ratio(span)
    return max(64, int(math.ceil(math.log(rel) / math.log(r))))


def block_size(span: float) -> int:
    """Chunk rows for the EWMA layout: a window partition holds up to ~1.5 chunks plus the halo, and
    r^(rows / 2) must stay above 1e-150 (1024 for span 6)."""
    r = _ratio(span)
    limit = 2 * 150 * math.log(10) / -math.log(r)  # rows per partition
    halo = halo_rows(span)
    # long spans need blocks that are longer than their halo
    return int(max(128, min(max(4096, halo + 64), (limit - halo) / 1.5)) // 64 * 64)


def _valid(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def ewma_window_columns(w: WindowSpec, col: str, span: float, out: str = "_ew") -> dict[str, Column]:
    """Step 1 on the chunk window ``w``; ``out`` is null where the value must come from an earlier
    chunk (no value among the home rows up to the current one)."""
    r = _ratio(span)
    x = F.col(col).cast("double")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    idx = F.row_number().over(w).cast("double")
    mid = F.count(F.lit(1)).over(whole).cast("double") / F.lit(2.0)
    weight = F.pow(F.lit(r), mid - idx)
    valid = _valid(x)
    u = F.sum(F.when(valid, x * weight)).over(run)
    v = F.sum(F.when(valid, weight)).over(run)
    seen_home = F.max(F.when(valid & F.col(HOME), F.lit(1))).over(run)
    return {out: F.when(seen_home.isNotNull(), u / v)}


def ewma_fill(df: DataFrame, keys, out: str, src: str = "_ew", order: str = "time") -> DataFrame:
    """Step 2 on the home rows (carrying ``_chunk``): rows before the first value of their chunk take
    the last value of an earlier chunk (null at the start of a series)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    last = F.max(F.when(F.col(src).isNotNull(), F.struct(F.col(order).alias("o"), F.col(src).alias("v"))))
    blocks = (df.groupBy(*keys, CHUNK).agg(last.alias("_eb"))
              .withColumn("_s", F.when(F.col("_eb").isNotNull(),
                                       F.struct(F.col(CHUNK).alias("b"), F.col("_eb.v").alias("v")))))
    prev = exclusive_scan(blocks.select(*keys, CHUNK, "_s"), keys, CHUNK, "_s", "max", "_prev")
    prev = prev.select(*[F.col(k).alias(f"_q_{k}") for k in keys], F.col(CHUNK).alias("_q_chunk"),
                       F.col("_prev.v").alias("_prev_v"))
    need = df.filter(F.col(src).isNull())
    cond = None
    for k in keys:
        e = need[k].eqNullSafe(prev[f"_q_{k}"])
        cond = e if cond is None else cond & e
    cond = cond & (need[CHUNK] == prev["_q_chunk"])
    filled = (need.join(prev, cond, "left").withColumn(out, F.col("_prev_v"))
              .drop("_prev_v", "_q_chunk", *[f"_q_{k}" for k in keys]))
    done = df.filter(F.col(src).isNotNull()).withColumn(out, F.col(src))
    return done.unionByName(filled).drop(src)
