"""Row-based series windows that never put a whole series into one task.

The reference's windows are row based per city (``shift(24)`` is 24 rows back). The plain Spark form,
``Window.partitionBy(city).orderBy(time)``, sends every row of a city to one task, so one hot city
(a third of all rows) becomes one task. Here each series is cut into chunks of about ``chunk_rows``
rows; rows within ``lookback`` rows before a chunk (or ``lookahead`` rows after it) are copied into it
("halo"), the windows run per (series, chunk), and the copies are dropped. Frames used by the features
reach at most 72 rows, so any chunk of at least that many rows gives exact results.

Two layouts produce the chunks:

* **Bucket layout (one shuffle).** Rows are grouped in (series, time bucket of 168 h, or 24 h / 1 h for dense series); a partial aggregate
  gives the bucket counts, a running total over that small table gives each bucket's row offset, and
  whole buckets are assigned to chunks (chunk = offset div C). Halo copies are whole buckets, decided
  from the same table. The table is broadcast to the rows, so the rows are shuffled once, by
  (series, chunk). Used when the table passes a size check (row count under ``MAX_BUCKET_TABLE_ROWS``)
  and no bucket exceeds a quarter chunk (which guarantees every chunk has >= 3/4 C rows, so halos come
  from the neighbour chunk only).
* **Series layout.** Where that table is too large to broadcast but no series is longer than a chunk (very many
  short series), a series is its own chunk: no offsets, no copies, one shuffle by series, and none where the rows
  are partitioned by series already.
* **Row-number layout (two shuffles, general).** Exact row positions from a window inside
  (series, bucket) plus bucket offsets, fixed chunks of C positions, halo rows copied individually.

All expose ``_chunk`` and ``_home`` and, when asked, ``_rn`` (row position in the series), ``_cs`` and
``_ce`` (first and one-past-last position of the row's chunk), which the exponential mean needs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

RN = "_rn"
CHUNK = "_chunk"
HOME = "_home"
CS = "_cs"
CE = "_ce"
BKT = "_bkt"

DEFAULT_CHUNK_ROWS = 4096
DEFAULT_BUCKET_HOURS = 168
BUCKET_RETRY_HOURS = (24, 1)
SCAN_GROUP = 1024
# Bucket tables up to this many rows (a few tens of MB) are broadcast; larger ones use the
# row-number layout.
MAX_BUCKET_TABLE_ROWS = 2_000_000

_LAYOUT_COLS = [RN, CHUNK, CS, CE, BKT, "_off"]


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _eq_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    cond = None
    for k in keys:
        e = left[k].eqNullSafe(right[f"{prefix}{k}"])
        cond = e if cond is None else cond & e
    return cond


def bucket_of(order: str, bucket_hours: int) -> Column:
    """Time bucket of ``bucket_hours`` hours, from the wall-clock date and hour (no time zone)."""
    t = F.col(order)
    hours = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long") * F.lit(24) + F.hour(t)
    return F.floor(hours / F.lit(bucket_hours)).cast("long")


def exclusive_scan(df: DataFrame, keys: Sequence[str], index: str, value: str, op: str, out: str,
                   group: int = SCAN_GROUP) -> DataFrame:
    """Exclusive prefix ``op`` ('sum' or 'max') of ``value`` along ``index`` within ``keys``.

    Two levels: a window inside (keys, index div group), and a window over the per-group totals, so
    no window partition holds more than ``group`` rows or (#index / group) rows.
    """
    agg = {"sum": F.sum, "max": F.max}[op]
    keys = list(keys)
    d = df.withColumn("_sup", F.floor(F.col(index) / F.lit(group)))
    w_in = Window.partitionBy(*keys, "_sup").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    inner = d.withColumn("_in", agg(value).over(w_in))
    tot = d.groupBy(*keys, "_sup").agg(agg(value).alias("_tot"))
    w_top = Window.partitionBy(*keys).orderBy("_sup").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col("_sup").alias("_t_sup"),
                     agg("_tot").over(w_top).alias("_pre"))
    cond = _eq_keys(inner, tot, keys, "_t_") & (inner["_sup"] == tot["_t_sup"])
    j = inner.join(tot, cond, "inner")
    if op == "sum":
        res = F.coalesce(F.col("_pre"), F.lit(0)) + F.coalesce(F.col("_in"), F.lit(0))
    else:
        res = F.greatest(F.col("_pre"), F.col("_in"))
    return j.withColumn(out, res).drop("_sup", "_in", "_pre", *[f"_t_{k}" for k in keys], "_t_sup")


# --- row-number layout ------------------------------------------------------------------------------

def number_rows(df: DataFrame, key, order: str = "time", tiebreak: Sequence[str] = (),
                bucket_hours: int = DEFAULT_BUCKET_HOURS, broadcast_offsets: bool = False) -> DataFrame:
    """Adds ``_rn``: 0-based position of the row in its series ordered by ``order``.

    Rows are numbered inside (series, time bucket) groups (one shuffle, groups bounded by the rows of
    one bucket); each bucket's offset is the running total of the bucket counts of its series. That
    table has one row per (series, bucket), so per series it is bounded by the time span divided by
    the bucket width, not by the number of rows; it is joined back on the same keys the rows are
    already partitioned by. The order must be unique within a series (``tiebreak`` otherwise).
    ``broadcast_offsets`` (set by the caller after checking the table's row count) ships the offsets
    to the rows instead of a sort-merge join.
    """
    keys = _keys(key)
    d = df.withColumn(BKT, bucket_of(order, bucket_hours))
    w_in = Window.partitionBy(*keys, BKT)
    ranked = d.withColumns({
        "_rn_in": F.row_number().over(w_in.orderBy(order, *tiebreak)) - F.lit(1),
        "_n": F.count(F.lit(1)).over(w_in),
    })
    # the first row of each bucket carries the bucket count: no extra aggregation or scan
    w_off = Window.partitionBy(*keys).orderBy(BKT).rowsBetween(Window.unboundedPreceding, -1)
    offs = (ranked.filter(F.col("_rn_in") == 0)
            .select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col(BKT).alias("_o_bkt"),
                    F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off")))
    cond = _eq_keys(ranked, offs, keys, "_o_") & (ranked[BKT] == offs["_o_bkt"])
    out = ranked.join(F.broadcast(offs) if broadcast_offsets else offs, cond, "inner")
    return (out.withColumn(RN, (F.col("_off") + F.col("_rn_in")).cast("long"))
            .drop(BKT, "_rn_in", "_n", "_off", "_o_bkt", *[f"_o_{k}" for k in keys]))


def halo_layout(df: DataFrame, lookback: int, lookahead: int, chunk_rows: int) -> DataFrame:
    """Fixed chunks of ``chunk_rows`` positions; boundary rows copied to neighbours (``_home`` false)."""
    if chunk_rows < max(lookback, lookahead, 1):
        raise ValueError("chunk_rows must cover the longest frame")
    rn = F.col(RN)
    c = F.floor(rn / F.lit(chunk_rows)).cast("long")
    pos = rn - c * F.lit(chunk_rows)
    copies = F.array(
        F.struct(c.alias(CHUNK), F.lit(True).alias(HOME)),
        F.when(pos >= F.lit(chunk_rows - lookback), F.struct((c + 1).alias(CHUNK), F.lit(False).alias(HOME))),
        F.when(pos < F.lit(lookahead), F.struct((c - 1).alias(CHUNK), F.lit(False).alias(HOME))),
    )
    out = df.select("*", F.inline(F.filter(copies, lambda s: s.isNotNull())))
    return out.withColumns({CS: F.col(CHUNK) * F.lit(chunk_rows), CE: (F.col(CHUNK) + 1) * F.lit(chunk_rows)})


# --- bucket layout ----------------------------------------------------------------------------------

def bucket_table(df: DataFrame, keys: Sequence[str], order: str, lookback: int, lookahead: int,
                 chunk_rows: int, bucket_hours: int) -> DataFrame:
    """One row per (series, bucket): count, offset and the chunks that need the bucket's rows."""
    counts = (df.select(*keys, bucket_of(order, bucket_hours).alias(BKT))
              .groupBy(*keys, BKT).agg(F.count(F.lit(1)).alias("_n")))
    w = Window.partitionBy(*keys).orderBy(BKT)
    b = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    b = b.withColumn(CHUNK, F.floor(F.col("_off") / F.lit(chunk_rows)).cast("long"))
    wc = Window.partitionBy(*keys, CHUNK)
    ws = Window.partitionBy(*keys)
    b = b.withColumns({CS: F.min("_off").over(wc), CE: F.max(F.col("_off") + F.col("_n")).over(wc),
                       "_last": F.max(CHUNK).over(ws)})
    end = F.col("_off") + F.col("_n")
    targets = F.array(
        F.struct(F.col(CHUNK).alias("c"), F.lit(True).alias("h")),
        F.when((F.col(CHUNK) < F.col("_last")) & (end > F.col(CE) - F.lit(lookback)),
               F.struct((F.col(CHUNK) + 1).alias("c"), F.lit(False).alias("h"))),
        F.when((F.col(CHUNK) > 0) & (F.col("_off") < F.col(CS) + F.lit(lookahead)),
               F.struct((F.col(CHUNK) - 1).alias("c"), F.lit(False).alias("h"))),
    )
    return b.select(*keys, BKT, "_n", "_off", CS, CE, F.filter(targets, lambda s: s.isNotNull()).alias("_targets"))


def bucket_layout(df: DataFrame, table: DataFrame, keys: Sequence[str], order: str,
                  tiebreak: Sequence[str] = (), with_position: bool = False,
                  bucket_hours: int = DEFAULT_BUCKET_HOURS) -> DataFrame:
    """Rows joined with the (checked, broadcast) bucket table and replicated into their chunks.

    With ``with_position`` the row position is ``bucket offset + rank inside the bucket``; every copy of
    a bucket carries all its rows, so the rank is right in every chunk. ``_cs``/``_ce`` are those of
    the row's home chunk (only home rows use them)."""
    t = table.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col(BKT).alias("_b_bkt"), "_off", CS, CE,
                     "_targets")
    d = df.withColumn(BKT, bucket_of(order, bucket_hours))
    j = d.join(F.broadcast(t), _eq_keys(d, t, keys, "_b_") & (d[BKT] == t["_b_bkt"]), "inner")
    j = j.drop(*[f"_b_{k}" for k in keys], "_b_bkt")
    laid = (j.select("*", F.inline("_targets")).withColumnRenamed("c", CHUNK).withColumnRenamed("h", HOME)
            .drop("_targets"))
    if not with_position:
        return laid.drop(CS, CE)
    w = Window.partitionBy(*keys, CHUNK, BKT).orderBy(order, *tiebreak)
    return laid.withColumn(RN, (F.col("_off") + F.row_number().over(w) - F.lit(1)).cast("long"))


def check_bucket_table(table: DataFrame, chunk_rows: int, lookback: int, lookahead: int) -> tuple[bool, bool, bool]:
    """Size check before broadcasting, from one small aggregate: (table small enough to broadcast,
    every bucket small enough for the bucket layout, every series no longer than a chunk)."""
    row = table.agg(F.count(F.lit(1)).alias("rows"), F.max("_n").alias("biggest"),
                    F.max(F.col("_off") + F.col("_n")).alias("longest")).first()
    if row["rows"] == 0:
        return True, True, True
    limit = min(chunk_rows - max(lookback, lookahead), chunk_rows // 4)
    return row["rows"] <= MAX_BUCKET_TABLE_ROWS, row["biggest"] <= limit, row["longest"] <= chunk_rows


# --- series layout ----------------------------------------------------------------------------------

def series_layout(df: DataFrame, keys: Sequence[str], order: str, tiebreak: Sequence[str] = (),
                  with_position: bool = False) -> DataFrame:
    """One chunk per series, for series that are known to be short; rows without a time have no place in any layout."""
    laid = df.filter(F.col(order).isNotNull()).withColumns({CHUNK: F.lit(0).cast("long"), HOME: F.lit(True)})
    if not with_position:
        return laid
    w = Window.partitionBy(*keys)
    return laid.withColumns({RN: (F.row_number().over(w.orderBy(order, *tiebreak)) - F.lit(1)).cast("long"),
                             CS: F.lit(0).cast("long"), CE: F.count(F.lit(1)).over(w)})


def over_series(df: DataFrame, key, compute: Callable[[DataFrame, WindowSpec], DataFrame], *,
                order: str = "time", lookback: int = 0, lookahead: int = 0,
                chunk_rows: int | None = DEFAULT_CHUNK_ROWS, tiebreak: Sequence[str] = (),
                bucket_hours: int = DEFAULT_BUCKET_HOURS, keep_position: bool = False,
                layout: str = "auto") -> DataFrame:
    """Runs ``compute(df, window)`` where ``window`` is partitioned per series (chunk) and ordered.

    ``chunk_rows=None`` gives the plain per-series window (one task per series; for inputs bounded per
    series and as a cross-check). Otherwise ``layout`` is "auto" (bucket layout when its table passes
    the check, else row numbers), "bucket" or "rows". ``compute`` may only use frames that reach at
    most ``lookback`` rows back and ``lookahead`` rows ahead. ``keep_position`` keeps ``_rn``,
    ``_chunk``, ``_cs`` and ``_ce`` on the output (home rows only).
    """
    keys = _keys(key)
    if chunk_rows is None:
        w = Window.partitionBy(*keys).orderBy(order, *tiebreak)
        return compute(df, w)
    if chunk_rows < max(lookback, lookahead, 1):
        raise ValueError("chunk_rows must cover the longest frame")
    use_bucket, small_table, use_series = False, False, layout == "series"
    if layout in ("auto", "bucket"):
        # dense series: retry with finer buckets (whole-bucket halos stay small) before giving up the
        # one-shuffle layout; a finer table is only tried while the coarser one was small enough
        for hours in dict.fromkeys([bucket_hours, *[h for h in BUCKET_RETRY_HOURS if h < bucket_hours]]):
            table = bucket_table(df, keys, order, lookback, lookahead, chunk_rows, hours).persist()
            small_table, small_buckets, short = check_bucket_table(table, chunk_rows, lookback, lookahead)
            use_bucket = small_table and small_buckets
            use_series = layout == "auto" and short and not small_table
            if use_bucket or not small_table:
                bucket_hours = hours
                break
            table.unpersist()
        if layout == "bucket" and not use_bucket:
            raise ValueError("bucket table too large or buckets too big for the chunk size")
        if not use_bucket:
            table.unpersist()
    if use_bucket:
        laid = bucket_layout(df, table, keys, order, tiebreak, keep_position, bucket_hours)
        w = Window.partitionBy(*keys, CHUNK).orderBy(order, *tiebreak)
    elif use_series:
        laid = series_layout(df, keys, order, tiebreak, keep_position)
        w = Window.partitionBy(*keys).orderBy(order, *tiebreak)
    else:
        numbered = number_rows(df, keys, order, tiebreak, bucket_hours, broadcast_offsets=small_table)
        laid = halo_layout(numbered, lookback, lookahead, chunk_rows)
        w = Window.partitionBy(*keys, CHUNK).orderBy(RN)
    out = compute(laid, w).filter(F.col(HOME)).drop(HOME)
    drop = [c for c in _LAYOUT_COLS if c in out.columns and (not keep_position or c in (BKT, "_off"))]
    return out.drop(*drop)
