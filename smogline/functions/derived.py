"""Row-level derived features and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pm_ratio(pm25="pm2_5", pm10="pm10") -> Column:
    """pm2_5 / pm10 with pm10 = 0 -> null (plain ``/ 0`` raises under ANSI mode)."""
    return _c(pm25) / F.nullif(_c(pm10), F.lit(0.0))


def wind_pollution(wind="wind_speed_10m", pm25="pm2_5") -> Column:
    return _c(wind) * _c(pm25)


def wind_vector(speed="wind_speed_10m", direction="wind_direction_10m") -> dict[str, Column]:
    rad = F.radians(_c(direction))
    return {"wind_u": -_c(speed) * F.sin(rad), "wind_v": -_c(speed) * F.cos(rad)}


def aqi_trend(aqi="aqi", lag24="aqi_lag_24h") -> Column:
    return _c(aqi) - _c(lag24)


def temp_inversion(temp="temperature_2m", wind="wind_speed_10m") -> Column:
    """temp / (wind + 0.1); a zero denominator gives null instead of infinity."""
    return F.try_divide(_c(temp), _c(wind) + F.lit(0.1))


def delta_label(target, aqi="aqi") -> Column:
    return _c(target) - _c(aqi)


def forecast_from_delta(aqi="aqi", delta="delta") -> Column:
    """max(aqi + delta, 0); a null input stays null (``greatest`` alone would turn it into 0)."""
    s = _c(aqi).cast("double") + _c(delta).cast("double")
    return F.when(s.isNotNull() & ~F.isnan(s), F.greatest(s, F.lit(0.0))).otherwise(s)
