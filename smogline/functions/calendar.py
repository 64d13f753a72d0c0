"""Calendar features (P3), season (P4) and cyclic encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month -> season.
SEASON_MONTHS = {
    "winter": (12, 1, 2),
    "spring": (3, 4, 5),
    "summer": (6, 7, 8),
}
SEASON_OTHER = "autumn"
WEEKEND_DAYS = (5, 6)  # Monday = 0


def ntz_lit(value) -> Column:
    """``timestamp_ntz`` literal from a naive ``datetime`` (wall clock), independent of the Python and
    session time zones (``F.lit(datetime)`` converts through both)."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def hour_floor(t) -> Column:
    """Wall-clock hour of a ``timestamp_ntz`` (no session time zone involved, unlike ``date_trunc``)."""
    c = F.col(t) if isinstance(t, str) else t
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.lit(0), F.lit(0))


def season(month="month") -> Column:
    m = F.col(month) if isinstance(month, str) else month
    expr = None
    for name, months in SEASON_MONTHS.items():
        cond = m.isin(*months)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(SEASON_OTHER))


def calendar_columns(time="time") -> dict[str, Column]:
    t = F.col(time)
    weekday = F.weekday(t).cast("bigint")
    return {
        "hour": F.hour(t).cast("bigint"),
        "day": F.dayofmonth(t).cast("bigint"),
        "month": F.month(t).cast("bigint"),
        "weekday": weekday,
        "is_weekend": weekday.isin(*WEEKEND_DAYS).cast("bigint"),
        "season": season(F.month(t)),
    }


def add_calendar(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumns(calendar_columns(time))


def cyclic_columns(hour="hour", month="month") -> dict[str, Column]:
    h, m = F.col(hour), F.col(month)
    two_pi = 2 * math.pi
    return {
        "hour_sin": F.sin(F.lit(two_pi) * h / F.lit(24.0)),
        "hour_cos": F.cos(F.lit(two_pi) * h / F.lit(24.0)),
        "month_sin": F.sin(F.lit(two_pi) * m / F.lit(12.0)),
        "month_cos": F.cos(F.lit(two_pi) * m / F.lit(12.0)),
    }
