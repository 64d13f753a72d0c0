"""Feature build (P18) and per-horizon training matrix (P15 -> W6-W10 -> P7-P11 -> P17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import derived
from ..functions.calendar import calendar_columns, cyclic_columns
from ..operators import windows as W
from ..operators.ewma import block_size, ewma_fill, ewma_window_columns, halo_rows
from ..operators.sequence import DEFAULT_CHUNK_ROWS, over_series
from ..session import cut_lineage
from ..schemas import FEATURE_COLUMNS, KEY, MODEL_BASE_COLUMNS, MODEL_EXTRA_COLUMNS

EWMA_SPAN = 6


def feature_windows(d: DataFrame, w) -> DataFrame:
    prefix = W.is_integral(d, "aqi")
    if prefix:
        d = d.withColumns(W.prefix_columns(w, "aqi"))
    cols = {}
    cols.update(W.lag_columns(w))
    cols.update(W.rolling_columns_prefix(w) if prefix else W.rolling_columns(w))
    cols.update(W.diff_columns(w))
    cols.update(W.target_columns(w))
    d = d.withColumns(cols)
    return W.drop_prefix(d, "aqi") if prefix else d


def build_features(readings: DataFrame, drop_incomplete: bool = True,
                   chunk_rows: int | None = DEFAULT_CHUNK_ROWS, key=KEY, compute=feature_windows, keep=(),
                   **layout) -> DataFrame:
    """50-column feature table from readings with ``aqi``.

    One shuffle for the row numbering and one for the chunked windows, whatever the number of cities
    or the size of the largest one. ``drop_incomplete`` keeps rows with a 24 h lag and a 72 h target
    (training); live scoring keeps every row. ``key`` may name more columns that bound a series, ``compute`` add
    columns to the windows, and ``keep`` names those that stay beside the 50.
    """
    d = readings.withColumns(calendar_columns("time"))
    out = over_series(d, key, compute, lookback=W.FEATURE_LOOKBACK, lookahead=W.FEATURE_LOOKAHEAD,
                      chunk_rows=chunk_rows, **layout)
    out = out.withColumns({
        "pm_ratio": derived.pm_ratio(),
        "wind_pollution_interaction": derived.wind_pollution(),
    })
    if drop_incomplete:
        out = out.filter(F.col("aqi_lag_24h").isNotNull() & F.col("target_aqi_72h").isNotNull())
    return out.select(*FEATURE_COLUMNS, *keep)


def training_features(features: DataFrame, target: str, span: float = EWMA_SPAN,
                      materialize: bool = True, block: int | None = None, ewma_halo: int | None = None,
                      **layout) -> DataFrame:
    """Rows with a label for ``target`` plus the 13 training-time columns.

    The windows run after the label filter, as in the reference: a row without a target is not part
    of the frames of its neighbours. One shuffle (chunked windows incl. the exponential mean), then a
    small fill for rows whose last index value lies in an earlier chunk.
    """
    labelled = features.filter(F.col(target).isNotNull())
    block = block or block_size(span)
    halo = ewma_halo or halo_rows(span)

    def compute(d, w):
        prefix = W.is_integral(d, "aqi")
        if prefix:
            d = d.withColumns(W.prefix_columns(w, "aqi"))
        cols = W.training_window_columns_prefix(w) if prefix else W.training_window_columns(w)
        cols.update(ewma_window_columns(w, "aqi", span))
        d = d.withColumns(cols)
        return W.drop_prefix(d, "aqi") if prefix else d

    out = over_series(labelled, KEY, compute, lookback=max(W.TRAINING_LOOKBACK, halo), lookahead=0,
                      chunk_rows=block, keep_position=True, **layout)
    if materialize:
        # the fill reads this table three times (per-chunk last values, rows to fill, the rest)
        out = cut_lineage(out, "training-windows")
    out = ewma_fill(out, [KEY], "aqi_ewma_6h").drop("_rn", "_chunk", "_cs", "_ce")
    cols = cyclic_columns()
    cols.update(derived.wind_vector())
    cols["aqi_trend_24h"] = derived.aqi_trend()
    cols["temp_inversion_proxy"] = derived.temp_inversion()
    cols["target_delta"] = derived.delta_label(target)
    return out.withColumns(cols)


def training_matrix(features: DataFrame, target: str, **kw) -> DataFrame:
    """The listed columns that exist, the 13 derived ones, ``time`` (for the split) and labels."""
    t = training_features(features, target, **kw)
    base = [c for c in MODEL_BASE_COLUMNS if c in t.columns]
    return t.select("time", *base, *MODEL_EXTRA_COLUMNS, "target_delta", target)
