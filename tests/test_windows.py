"""Chunked halo layout equals the plain per-series window; goldens by position; no leakage."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from smogline.plans import features as FT
from smogline.schemas import FEATURE_COLUMNS, ROLLING_WINDOWS

STD = [f"aqi_roll_std_{n}h" for n in ROLLING_WINDOWS]


def _pdf(df, cols):
    return df.select(*cols).toPandas().sort_values(["city", "time"]).reset_index(drop=True)


def _assert_frames_equal(a, b):
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype.kind in "fc" or y.dtype.kind in "fc":
            np.testing.assert_allclose(x.astype(float), y.astype(float), rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=c)
        else:
            assert list(x.where(x.notna(), None)) == list(y.where(y.notna(), None)), c


@pytest.mark.parametrize("chunk,hours,layout", [(100, 168, "rows"), (173, 168, "auto"), (100, 24, "bucket"),
                                                (400, 48, "bucket"), (80, 6, "bucket")])
def test_chunked_equals_plain(readings, chunk, hours, layout):
    plain = FT.build_features(readings, drop_incomplete=False, chunk_rows=None)
    chunked = FT.build_features(readings, drop_incomplete=False, chunk_rows=chunk, bucket_hours=hours, layout=layout)
    _assert_frames_equal(_pdf(plain, FEATURE_COLUMNS), _pdf(chunked, FEATURE_COLUMNS))


def series_of(df, cols):
    """City -> rows (dicts) in time order, missing numbers as None."""
    out = {}
    for r in df.select("city", "time", *cols).collect():
        d = r.asDict()
        out.setdefault(d["city"], []).append({k: None if isinstance(v, float) and math.isnan(v) else v for k, v in d.items()})
    return {c: sorted(rows, key=lambda d: d["time"]) for c, rows in out.items()}


def at(values, i):
    return values[i] if 0 <= i < len(values) else None


def sample_deviation(xs):
    centre = sum(xs) / len(xs)
    return math.sqrt(sum((x - centre) ** 2 for x in xs) / (len(xs) - 1))


def expected_features(aqi, i):
    """Row ``i`` of one series by position arithmetic: lags, targets, full windows of the rows before it."""
    want = {f"aqi_lag_{n}h": at(aqi, i - n) for n in (1, 3, 6, 12, 24)}
    want |= {f"target_aqi_{h}h": at(aqi, i + h) for h in (24, 48, 72)}
    now, before = aqi[i], at(aqi, i - 1)
    want["aqi_change_rate"] = None if now is None or before is None else now - before
    for n in ROLLING_WINDOWS:
        frame = aqi[i - n:i] if i >= n else []
        whole = len(frame) == n and None not in frame
        want[f"aqi_roll_mean_{n}h"] = sum(frame) / n if whole else None
        want[f"aqi_roll_max_{n}h"] = max(frame) if whole else None
        want[f"aqi_roll_min_{n}h"] = min(frame) if whole else None
        want[f"aqi_roll_std_{n}h"] = sample_deviation(frame) if whole else None
    return want


def assert_row(got, want, tolerance=1e-9):
    for name, value in want.items():
        if value is None:
            assert got[name] is None, (name, got)
        else:
            assert got[name] == pytest.approx(value, rel=tolerance, abs=tolerance), (name, got)


def test_features_match_position_arithmetic(readings):
    feats = FT.build_features(readings, drop_incomplete=False, chunk_rows=80)
    truth = series_of(readings, ["aqi"])
    names = list(expected_features([1], 0))
    seen = 0
    for city, rows in series_of(feats, names).items():
        aqi = [r["aqi"] for r in truth[city]]
        assert [r["time"] for r in rows] == [r["time"] for r in truth[city]]
        for i, row in enumerate(rows):
            assert_row(row, expected_features(aqi, i))
            seen += 1
    assert seen == readings.count()


def expected_training(rows, i, span=6):
    """Row ``i`` of one labelled series: weights spelled out, windows that include the row itself."""
    keep = 1.0 - 2.0 / (span + 1.0)
    weights = [(keep ** (i - j), rows[j]["aqi"]) for j in range(i + 1) if rows[j]["aqi"] is not None]
    total = sum(w for w, _ in weights)
    in_frame = lambda n: [r["aqi"] for r in rows[max(0, i - n + 1):i + 1] if r["aqi"] is not None]
    two_days, three_days = in_frame(48), in_frame(72)
    earlier = rows[i - 12]["surface_pressure"] if i >= 12 else None
    return {
        "aqi_ewma_6h": sum(w * x for w, x in weights) / total if weights else None,
        "aqi_roll_mean_48h": sum(two_days) / len(two_days) if two_days else None,
        "aqi_roll_max_72h": max(three_days) if three_days else None,
        "aqi_roll_std_48h": sample_deviation(two_days) if len(two_days) > 1 else 0.0,
        "pressure_trend_12h": rows[i]["surface_pressure"] - (earlier if earlier is not None else 0.0),
    }


@pytest.mark.parametrize("block,hours,layout", [(80, 168, "rows"), (128, 168, "rows"), (96, 24, "bucket"),
                                                (160, 24, "bucket")])
def test_training_windows_of_small_blocks(readings, block, hours, layout):
    """Chunks far smaller than a series and a 72-row EWMA halo (older weights < r^72 ~ 3e-11) force
    the cross-chunk history and the cross-chunk null fill."""
    feats = FT.build_features(readings, drop_incomplete=False, chunk_rows=None)
    # long null runs: blank out the index on a stretch of one series
    feats = feats.withColumn("aqi", F.when((F.col("city") == "click") & (F.dayofmonth("time").between(3, 9)),
                                           F.lit(None)).otherwise(F.col("aqi")))
    got = FT.training_features(feats, "target_aqi_24h", block=block, materialize=False, bucket_hours=hours,
                               layout=layout, ewma_halo=72)
    truth = series_of(feats.filter("target_aqi_24h is not null"), ["aqi", "surface_pressure"])
    for city, rows in series_of(got, list(expected_training([{"aqi": 1, "surface_pressure": 0.0}], 0))).items():
        assert len(rows) == len(truth[city])
        for i, row in enumerate(rows):
            assert_row(row, expected_training(truth[city], i))


def test_long_ewma_spans_have_room():
    from smogline.operators.ewma import block_size, halo_rows
    for span in (2, 6, 48, 97, 168, 720):
        assert block_size(span) > halo_rows(span) or span < 6


def test_no_leakage_between_cities(spark, readings):
    """Shifting one city's rows in time never changes another city's features."""
    base = FT.build_features(readings, drop_incomplete=False, chunk_rows=100)
    moved = readings.withColumn("time", F.when(F.col("city") == "view", F.col("time") + F.expr("INTERVAL 5 DAYS"))
                                .otherwise(F.col("time")))
    other = FT.build_features(moved, drop_incomplete=False, chunk_rows=100)
    a = _pdf(base.filter(F.col("city") != "view"), FEATURE_COLUMNS)
    b = _pdf(other.filter(F.col("city") != "view"), FEATURE_COLUMNS)
    _assert_frames_equal(a, b)


def test_input_order_does_not_matter(readings):
    a = _pdf(FT.build_features(readings, chunk_rows=90), FEATURE_COLUMNS)
    b = _pdf(FT.build_features(readings.repartition(7).orderBy(F.rand(3)), chunk_rows=90), FEATURE_COLUMNS)
    _assert_frames_equal(a, b)


def test_hot_series_is_split_and_exact(spark):
    """One key with every row (lineitem folded into one series): chunks spread it, results equal."""
    from smogline.operators.sequence import CHUNK, over_series
    from smogline.sources.adapter import readings_hot_series
    hot = readings_hot_series(spark, "/root/testdata/sf0.01")
    n = hot.count()
    assert hot.select("time").distinct().count() == n
    plain = FT.build_features(hot, drop_incomplete=False, chunk_rows=None)
    chunked = FT.build_features(hot, drop_incomplete=False, chunk_rows=4096)
    _assert_frames_equal(_pdf(plain, FEATURE_COLUMNS), _pdf(chunked, FEATURE_COLUMNS))
    sizes = over_series(hot, "city", lambda d, w: d, lookback=24, lookahead=72, keep_position=True) \
        .groupBy(CHUNK).count().collect()
    assert len(sizes) >= n // 4096 and max(r["count"] for r in sizes) <= 4096 * 5 // 4
