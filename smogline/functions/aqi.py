"""Air quality index from EPA breakpoints (P1, P2), alert levels.

Everything here returns a ``Column`` built from native expressions (``when`` chains, ``rint``,
``greatest``), so it stays inside whole-stage codegen and works the same on batch and stream input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Must equal the published EPA tables used for the index.
# Each entry: (concentration low, concentration high, index low, index high).
# ---------------------------------------------------------------------------------------------
PM25_BREAKPOINTS = [
    (0.0, 12.0, 0, 50),
    (12.1, 35.4, 51, 100),
    (35.5, 55.4, 101, 150),
    (55.5, 150.4, 151, 200),
    (150.5, 250.4, 201, 300),
    (250.5, 350.4, 301, 400),
    (350.5, 500.4, 401, 500),
]
PM10_BREAKPOINTS = [
    (0, 54, 0, 50),
    (55, 154, 51, 100),
    (155, 254, 101, 150),
    (255, 354, 151, 200),
    (355, 424, 201, 300),
    (425, 504, 301, 400),
    (505, 604, 401, 500),
]
INDEX_CAP = 500
# Truncation steps of the EPA reporting rule (gap="truncate"): PM2.5 to 0.1, PM10 to 1.
TRUNCATION_STEP = {"pm25": 10.0, "pm10": 1.0}

# Alert levels: strict lower bound -> (label, colour); below every bound -> Good; null -> Unknown.
ALERT_LEVELS = [
    (300, "Hazardous", "darkred"),
    (200, "Very Unhealthy - Red Alert", "red"),
    (150, "Unhealthy - Orange Alert", "orange"),
    (100, "Unhealthy for Sensitive Groups", "gold"),
    (50, "Moderate", "yellowgreen"),
]
ALERT_DEFAULT = ("Good", "green")
ALERT_UNKNOWN = ("Unknown", "gray")

TABLES = {"pm25": PM25_BREAKPOINTS, "pm10": PM10_BREAKPOINTS}


def _slope(lo, hi, alo, ahi) -> float:
    # Same operand order and types as the index definition: (index span) / (concentration span).
    return (ahi - alo) / (hi - lo)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _truncated(c: Column, pollutant: str) -> Column:
    step = TRUNCATION_STEP[pollutant]
    if step == 1.0:
        return F.floor(c).cast("double")
    return F.floor(c * F.lit(step)).cast("double") / F.lit(step)


def sub_index(conc, pollutant: str = "pm25", gap: str = "zero") -> Column:
    """Piecewise-linear sub-index of one pollutant, half-to-even rounded, as ``int``.

    null -> null; NaN -> 0 (NaN compares false in the definition, but Spark orders it above every
    number, so it is tested first); inside a bucket -> linear scale; above the top -> 500;
    negative or inside a gap between buckets -> 0 (``gap="zero"``). ``gap="truncate"`` applies the
    EPA truncation (0.1 for PM2.5, 1 for PM10) before the lookup, which closes the gaps.
    """
    if isinstance(conc, str):
        # same rule as one SQL expression: parsed once instead of ~100 driver calls per use
        return F.expr(sub_index_sql(f"`{conc}`", pollutant, gap, dialect="spark"))
    table = TABLES[pollutant]
    c = _col(conc)
    x = _truncated(c, pollutant) if gap == "truncate" else c
    expr = F.when(c.isNull(), F.lit(None)).when(F.isnan(c), F.lit(0))
    for lo, hi, alo, ahi in table:
        lin = F.lit(_slope(lo, hi, alo, ahi)) * (x - F.lit(float(lo))) + F.lit(float(alo))
        expr = expr.when((x >= F.lit(float(lo))) & (x <= F.lit(float(hi))), F.rint(lin).cast("int"))
    expr = expr.when(x > F.lit(float(table[-1][1])), F.lit(INDEX_CAP)).otherwise(F.lit(0))
    return expr.cast("int")


def aqi(pm25="pm2_5", pm10="pm10", missing: str = "skip", gap: str = "zero") -> Column:
    """Overall index = max of the PM2.5 and PM10 sub-indices.

    ``missing="skip"`` (live rows): a null reading is skipped, both null -> null.
    ``missing="zero"`` (history rows): a missing reading counts as sub-index 0, so never null.
    """
    if missing not in ("skip", "zero"):
        raise ValueError(f"unknown missing mode {missing!r}")
    if isinstance(pm25, str) and isinstance(pm10, str):
        return F.expr(aqi_sql(f"`{pm25}`", f"`{pm10}`", missing, gap, dialect="spark"))
    s25 = sub_index(pm25, "pm25", gap)
    s10 = sub_index(pm10, "pm10", gap)
    if missing == "zero":
        s25, s10 = F.coalesce(s25, F.lit(0)), F.coalesce(s10, F.lit(0))
    elif missing != "skip":
        raise ValueError(f"unknown missing mode {missing!r}")
    return F.greatest(s25, s10).cast("int")


def with_aqi(df, missing: str = "skip", gap: str = "zero"):
    return df.withColumn("aqi", aqi("pm2_5", "pm10", missing=missing, gap=gap))


def alert_level(value="aqi") -> Column:
    """(level, colour) struct by strict thresholds; null and NaN -> Unknown."""
    v = _col(value)
    unknown = F.struct(F.lit(ALERT_UNKNOWN[0]).alias("level"), F.lit(ALERT_UNKNOWN[1]).alias("colour"))
    expr = F.when(v.isNull() | F.isnan(v.cast("double")), unknown)
    for bound, label, colour in ALERT_LEVELS:
        expr = expr.when(v > F.lit(bound), F.struct(F.lit(label).alias("level"), F.lit(colour).alias("colour")))
    return expr.otherwise(F.struct(F.lit(ALERT_DEFAULT[0]).alias("level"), F.lit(ALERT_DEFAULT[1]).alias("colour")))


# --- SQL text of the same rules, for the DuckDB oracle and for spark.sql users -----------------

def sql_double(x: float) -> str:
    """Exact double literal that both Spark SQL and DuckDB read as DOUBLE."""
    r = repr(float(x))
    return r if ("e" in r or "n" in r) else r + "e0"


def sub_index_sql(expr: str, pollutant: str = "pm25", gap: str = "zero", dialect: str = "duckdb") -> str:
    table = TABLES[pollutant]
    rnd = "round_even({}, 0)" if dialect == "duckdb" else "rint({})"
    step = TRUNCATION_STEP[pollutant]
    if gap == "truncate":
        x = f"floor({expr})" if step == 1.0 else f"(floor(({expr}) * {sql_double(step)}) / {sql_double(step)})"
    else:
        x = f"({expr})"
    parts = [f"CASE WHEN ({expr}) IS NULL THEN NULL WHEN isnan({expr}) THEN 0"]
    for lo, hi, alo, ahi in table:
        lin = f"{sql_double(_slope(lo, hi, alo, ahi))} * ({x} - {sql_double(lo)}) + {sql_double(alo)}"
        parts.append(f"WHEN {x} >= {sql_double(lo)} AND {x} <= {sql_double(hi)} "
                     f"THEN CAST({rnd.format(lin)} AS INTEGER)")
    parts.append(f"WHEN {x} > {sql_double(table[-1][1])} THEN {INDEX_CAP} ELSE 0 END")
    return "CAST(" + " ".join(parts) + " AS INTEGER)"


def aqi_sql(pm25: str = "pm2_5", pm10: str = "pm10", missing: str = "skip", gap: str = "zero",
            dialect: str = "duckdb") -> str:
    a = sub_index_sql(pm25, "pm25", gap, dialect)
    b = sub_index_sql(pm10, "pm10", gap, dialect)
    if missing == "zero":
        a, b = f"coalesce({a}, 0)", f"coalesce({b}, 0)"
    return f"CAST(greatest({a}, {b}) AS INTEGER)"


def alert_sql(expr: str = "aqi", field: str = "level") -> str:
    i = 0 if field == "level" else 1
    parts = [f"CASE WHEN ({expr}) IS NULL OR isnan(CAST({expr} AS DOUBLE)) THEN '{ALERT_UNKNOWN[i]}'"]
    for bound, label, colour in ALERT_LEVELS:
        parts.append(f"WHEN ({expr}) > {bound} THEN '{(label, colour)[i]}'")
    parts.append(f"ELSE '{ALERT_DEFAULT[i]}' END")
    return " ".join(parts)
