"""Per-series window features: lags (W1), rolling stats (W2), differences (W3), targets (W4),
and the training-time windows (W7-W10). All row based, partitioned per series, so nothing leaks
from one city into another.

Each builder returns ``{name: Column}`` for a given ``WindowSpec``; Spark plans all columns that share
the partitioning and order into one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from ..schemas import HORIZONS, LAG_HOURS, ROLLING_WINDOWS


def lag_columns(w: WindowSpec, col: str = "aqi", lags=LAG_HOURS) -> dict[str, Column]:
    return {f"{col}_lag_{n}h": F.lag(col, n).over(w) for n in lags}


def rolling_columns(w: WindowSpec, col: str = "aqi", windows=ROLLING_WINDOWS) -> dict[str, Column]:
    """Stats over the n rows before the current one; null unless all n are present and non-null."""
    out = {}
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        full = F.count(col).over(frame) == F.lit(n)
        out[f"{col}_roll_mean_{n}h"] = F.when(full, F.avg(col).over(frame))
        out[f"{col}_roll_max_{n}h"] = F.when(full, F.max(col).over(frame))
        out[f"{col}_roll_min_{n}h"] = F.when(full, F.min(col).over(frame))
        out[f"{col}_roll_std_{n}h"] = F.when(full, F.stddev_samp(col).over(frame))
    return out


def diff_columns(w: WindowSpec) -> dict[str, Column]:
    return {
        "aqi_change_rate": F.col("aqi") - F.lag("aqi", 1).over(w),
        "temp_diff": F.col("temperature_2m") - F.lag("temperature_2m", 1).over(w),
        "humidity_diff": F.col("relative_humidity_2m") - F.lag("relative_humidity_2m", 1).over(w),
    }


def target_columns(w: WindowSpec, col: str = "aqi", horizons=HORIZONS) -> dict[str, Column]:
    return {f"target_{col}_{h}h": F.lead(col, h).over(w) for h in horizons}


def training_window_columns(w: WindowSpec) -> dict[str, Column]:
    """Frames include the current row and need one value (``min_periods=1``)."""
    f48 = w.rowsBetween(-47, 0)
    f72 = w.rowsBetween(-71, 0)
    return {
        "aqi_roll_mean_48h": F.avg("aqi").over(f48),
        "aqi_roll_max_72h": F.max("aqi").over(f72),
        "aqi_roll_std_48h": F.coalesce(F.stddev_samp("aqi").over(f48), F.lit(0.0)),
        "pressure_trend_12h": F.col("surface_pressure") - F.coalesce(F.lag("surface_pressure", 12).over(w), F.lit(0.0)),
    }


FEATURE_LOOKBACK = max(max(LAG_HOURS), max(ROLLING_WINDOWS))
FEATURE_LOOKAHEAD = max(HORIZONS)
TRAINING_LOOKBACK = 71


# --- prefix-sum form for integer columns -------------------------------------------------------------
# A sliding avg/stddev re-aggregates its whole frame for every row (O(rows x frame)). For an integer
# column, running count, sum and sum of squares are exact in double (far below 2^53), so any frame's
# count, mean and sample variance follow exactly from two lags of the running sums: O(rows).
# max/min keep the sliding frame.

def _p(col: str, what: str) -> str:
    return f"_p{what}_{col}"


def is_integral(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, IntegralType)


def prefix_columns(w: WindowSpec, col: str) -> dict[str, Column]:
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(col).cast("double")
    return {_p(col, "c"): F.count(col).over(run), _p(col, "s"): F.sum(x).over(run),
            _p(col, "q"): F.sum(x * x).over(run)}


def _frame_sums(w: WindowSpec, col: str, back: int, n: int):
    """(count, sum, sum of squares) over the n rows ending ``back`` rows before the current one."""
    def diff(what):
        hi = F.col(_p(col, what)) if back == 0 else F.lag(_p(col, what), back).over(w)
        lo = F.lag(_p(col, what), back + n).over(w)
        zero = F.lit(0) if what == "c" else F.lit(0.0)
        return F.coalesce(hi, zero) - F.coalesce(lo, zero)
    return diff("c"), diff("s"), diff("q")


def _sample_std(c: Column, s: Column, q: Column) -> Column:
    c = c.cast("double")
    return F.sqrt((c * q - s * s) / (c * (c - F.lit(1.0))))


def rolling_columns_prefix(w: WindowSpec, col: str = "aqi", windows=ROLLING_WINDOWS) -> dict[str, Column]:
    """Same results as ``rolling_columns`` for an integer column; needs ``prefix_columns`` first."""
    out = {}
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        c, s, q = _frame_sums(w, col, 1, n)
        full = c == F.lit(n)
        out[f"{col}_roll_mean_{n}h"] = F.when(full, s / c.cast("double"))
        out[f"{col}_roll_max_{n}h"] = F.when(full, F.max(col).over(frame))
        out[f"{col}_roll_min_{n}h"] = F.when(full, F.min(col).over(frame))
        out[f"{col}_roll_std_{n}h"] = F.when(full, _sample_std(c, s, q))
    return out


def training_window_columns_prefix(w: WindowSpec) -> dict[str, Column]:
    """W7-W10 with the 48-row mean and deviation from running sums (integer ``aqi``)."""
    c, s, q = _frame_sums(w, "aqi", 0, 48)
    return {
        "aqi_roll_mean_48h": F.when(c > 0, s / c.cast("double")),
        "aqi_roll_max_72h": F.max("aqi").over(w.rowsBetween(-71, 0)),
        "aqi_roll_std_48h": F.coalesce(F.when(c > 1, _sample_std(c, s, q)), F.lit(0.0)),
        "pressure_trend_12h": F.col("surface_pressure") - F.coalesce(F.lag("surface_pressure", 12).over(w), F.lit(0.0)),
    }


def drop_prefix(df: DataFrame, col: str) -> DataFrame:
    return df.drop(_p(col, "c"), _p(col, "s"), _p(col, "q"))
