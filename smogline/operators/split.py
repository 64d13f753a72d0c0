"""Chronological 80/20 split (L4) without a global row_number and without driver round trips.

The reference takes the first int(0.8 n) rows in time order as training rows. Here, with the total
order (time, city), optionally per group (e.g. one split per horizon in a single pass):

1. rows per (group, time) (hash aggregate, partial) -> a table with one row per distinct time stamp;
2. running count over that table (bounded by the number of distinct time stamps, not by rows) gives,
   per group, the cut time T and how many rows at T still belong to training (one row per group);
3. that one-row-per-group table is broadcast (its size is the number of groups); rows before T are
   train, after T test; only the rows of time T are ranked by city (a window over one time stamp,
   bounded by the number of series).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut_table(df: DataFrame, fraction: float, time: str = "time", group: Sequence[str] = (),
              drop_rows: int = 0) -> DataFrame:
    """One row per group: ``_cut`` (time T) and ``_m`` (train rows at T); T null when k = 0.

    k = int(n * fraction) - drop_rows, as Python's int() of the same double product."""
    group = list(group)
    per_time = df.groupBy(*group, time).agg(F.count(F.lit(1)).alias("_n"))
    w_all = Window.partitionBy(*group) if group else Window.partitionBy()
    w_run = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy(time).rowsBetween(
        Window.unboundedPreceding, 0)
    t = per_time.withColumns({"_tot": F.sum("_n").over(w_all), "_cum": F.sum("_n").over(w_run)})
    k = F.floor(F.col("_tot").cast("double") * F.lit(float(fraction))).cast("long") - F.lit(drop_rows)
    t = t.withColumn("_k", k).filter(F.col("_cum") >= F.col("_k"))
    first = F.min_by(F.struct(F.col(time).alias("t"), (F.col("_k") - (F.col("_cum") - F.col("_n"))).alias("m"),
                              F.col("_k").alias("k")), F.col(time))
    cut = t.groupBy(*group).agg(first.alias("_c")) if group else t.agg(first.alias("_c"))
    return cut.select(*group, F.when(F.col("_c.k") > 0, F.col("_c.t")).alias("_cut"),
                      F.when(F.col("_c.k") > 0, F.col("_c.m")).otherwise(F.lit(0)).alias("_m"))


def _flag(df: DataFrame, cut: DataFrame, time: str, key: str, group: Sequence[str], out: str) -> DataFrame:
    group = list(group)
    c = F.broadcast(cut)  # one row per group
    j = df.join(c, on=group, how="left") if group else df.join(c, how="left")
    at = F.col(time) == F.col("_cut")
    rest = j.filter(~at | F.col("_cut").isNull()).withColumn(
        out, F.coalesce(F.col(time) < F.col("_cut"), F.lit(False)))
    w = Window.partitionBy(*group, time).orderBy(key)
    tie = j.filter(at).withColumn(out, F.row_number().over(w) <= F.col("_m"))
    return rest.unionByName(tie).drop("_cut", "_m")


def chrono_split(df: DataFrame, fraction: float = 0.8, time: str = "time", key: str = "city",
                 purge_rows: int = 0, group: Sequence[str] = ()) -> DataFrame:
    """Adds ``is_train``: the first int(fraction * n) rows by (time, key), per ``group`` if given.

    ``purge_rows`` > 0 drops that many train rows just before the cut (their targets lie inside the
    test period); the default 0 keeps the reference's split."""
    out = _flag(df, cut_table(df, fraction, time, group), time, key, group, "is_train")
    if purge_rows > 0:
        keep = _flag(out, cut_table(df, fraction, time, group, purge_rows), time, key, group, "_keep")
        out = keep.filter(~F.col("is_train") | F.col("_keep")).drop("_keep")
    return out


def split(df: DataFrame, fraction: float = 0.8, **kw) -> tuple[DataFrame, DataFrame]:
    s = chrono_split(df, fraction, **kw)
    return s.filter(F.col("is_train")).drop("is_train"), s.filter(~F.col("is_train")).drop("is_train")
