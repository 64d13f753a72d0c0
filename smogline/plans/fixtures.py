"""Landed inputs derived by Spark from the readings view, written under the shared folder.

They give the source, store and stream operators real files to read: archive JSON (parallel arrays,
one record per city and day, so no record grows with the history), current JSON payloads, a CSV with
mixed ISO time formats, upsert batches and hourly live batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import POLLUTANT_COLUMNS, WEATHER_COLUMNS
from ..session import scratch_path
from ..sources.ingest import POLLUTION_RENAMES
from ..functions.calendar import ntz_lit

TIME_FMT = "yyyy-MM-dd'T'HH:mm"


def _field(name: str):
    # one-argument lambda (a second argument would be taken as the element index by ``transform``)
    return lambda x: x.getField(name)


def land_archive(raw: DataFrame) -> tuple[str, str]:
    """Weather and air archive payloads: {city, hourly: {time: [...], var: [...], ...}}."""
    spark = raw.sparkSession
    cols = WEATHER_COLUMNS + POLLUTANT_COLUMNS
    g = (raw.withColumn("_day", F.to_date("time"))
         .groupBy("city", "_day")
         .agg(F.sort_array(F.collect_list(F.struct("time", *cols))).alias("r")))
    out = []
    for kind, names in (("weather", WEATHER_COLUMNS), ("air", POLLUTANT_COLUMNS)):
        hourly = F.struct(F.transform("r", lambda x: F.date_format(x["time"], TIME_FMT)).alias("time"),
                          *[F.transform("r", _field(n)).alias(n) for n in names])
        path = scratch_path(spark, f"archive-{kind}")
        g.select("city", hourly.alias("hourly")).write.json(path)
        out.append(path)
    return out[0], out[1]


def land_malformed(raw: DataFrame) -> dict[str, str]:
    """Archive payloads of ``land_archive`` spoiled by the day of the year modulo 7: 0 one time too few, 1 the first
    variable's array missing, 2 a first time that is none, 3 no city, 4 text cut off, 5 and 6 as they are."""
    spark = raw.sparkSession
    cols = WEATHER_COLUMNS + POLLUTANT_COLUMNS
    k = F.dayofyear("_day") % 7
    g = (raw.withColumn("_day", F.to_date("time"))
         .groupBy("city", "_day")
         .agg(F.sort_array(F.collect_list(F.struct("time", *cols))).alias("r")))
    times = F.transform("r", lambda x: F.date_format(x["time"], TIME_FMT))
    time = (F.when(k == 0, F.slice(times, 1, F.size(times) - 1))
            .when(k == 2, F.concat(F.array(F.lit("not a time")), F.slice(times, 2, F.size(times))))
            .otherwise(times))
    out = {}
    for kind, names in (("weather", WEATHER_COLUMNS), ("air", POLLUTANT_COLUMNS)):
        # missing values stay in the arrays: null elements are written, null arrays are not
        first = F.when(k != 1, F.transform("r", _field(names[0]))).alias(names[0])
        rest = [F.transform("r", _field(n)).alias(n) for n in names[1:]]
        text = F.to_json(F.struct(F.when(k != 3, F.col("city")).alias("city"),
                                  F.struct(time.alias("time"), first, *rest).alias("hourly")))
        out[kind] = scratch_path(spark, f"malformed-{kind}")
        g.select((k == 4).alias("cut"), text.alias("t")).select(
            F.when(F.col("cut"), F.substring("t", F.lit(1), F.length("t") - 5)).otherwise(F.col("t"))
            .alias("value")).write.text(out[kind])
    return out


def land_current(raw: DataFrame) -> tuple[str, str]:
    """Current payloads from the latest row per city: weather ``current`` and pollution ``list``."""
    from ..operators.select import latest_row
    spark = raw.sparkSession
    latest = latest_row(raw)
    wpath, ppath = scratch_path(spark, "current-weather"), scratch_path(spark, "current-pollution")
    latest.select("city", F.struct(*WEATHER_COLUMNS).alias("current")).write.json(wpath)
    comps = F.struct(*[F.col(dst).alias(src) for src, dst in POLLUTION_RENAMES.items()])
    latest.select("city", F.array(F.struct(comps.alias("components"))).alias("list")).write.json(ppath)
    return wpath, ppath


def land_mixed_csv(readings: DataFrame) -> str:
    """CSV with 'T' separated times on even hours and blank separated ones on odd hours."""
    spark = readings.sparkSession
    t = F.when(F.hour("time") % 2 == 0, F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format("time", "yyyy-MM-dd HH:mm:ss"))
    path = scratch_path(spark, "mixed-csv")
    readings.withColumn("time", t).write.option("header", True).csv(path)
    return path


def upsert_batches(raw: DataFrame, last_rows: int = 100, bump: float = 10.0) -> list[DataFrame]:
    """Batch 1: all rows. Batch 2: the last ``last_rows`` rows per city with pm2_5 + ``bump``."""
    w = Window.partitionBy("city").orderBy(F.col("time").desc())
    b2 = (raw.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= last_rows).drop("_rk")
          .withColumn("pm2_5", F.col("pm2_5") + F.lit(bump)))
    return [raw, b2]


def live_hours(raw: DataFrame, hours: int = 24) -> tuple[DataFrame, list]:
    """(history, [hour, ...]): the last ``hours`` distinct hours of the global timeline are live."""
    last = [r["time"] for r in raw.select("time").distinct().orderBy(F.col("time").desc()).limit(hours).collect()]
    last.sort()
    history = raw.filter(F.col("time") < ntz_lit(last[0])) if last else raw
    return history, last


def land_batches(frames: list[DataFrame], name: str, single_file: bool = False) -> str:
    """Each frame as its own directory in landing order (``landed_seq`` column = position).

    ``single_file`` writes each batch as one file, so that a stream with ``maxFilesPerTrigger=1``
    sees one batch per trigger (used for hourly live batches: one row per series)."""
    spark = frames[0].sparkSession
    root = scratch_path(spark, name)
    for i, f in enumerate(frames):
        f = f.withColumn("landed_seq", F.lit(i).cast("long"))
        (f.coalesce(1) if single_file else f).write.parquet(f"{root}/b{i:06d}")
    return root
