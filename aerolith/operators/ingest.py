"""Readings and dimensions: parsing, first-wins dedup, upserts, allow-lists, cleaning, grid cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.columns import SENTINELS


def parsed(raw: DataFrame) -> DataFrame:
    """Raw string readings with ts, value and ok: rows that are not ok have no sensor or time, or a value that is no number.

    The time keeps its date and clock up to the second; an empty or missing value is a null.
    """
    text = F.nullif(F.trim("value"), F.lit(""))
    number = text.try_cast("double")
    ts = F.regexp_replace("ts", "T", " ").substr(1, 19).try_cast("timestamp_ntz")
    return raw.withColumns({"ts": ts, "value": number, "ok": F.col("sensor_id").isNotNull() & ts.isNotNull() & (text.isNull() | number.isNotNull())})


def normalised(raw: DataFrame) -> DataFrame:
    return parsed(raw).where("ok").drop("ok")


def rejects(raw: DataFrame) -> DataFrame:
    return parsed(raw).where("not ok").drop("ok")


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def station_dimension(registry: DataFrame) -> DataFrame:
    """One row a station, the first of the registry, with numbers parsed (null where they can't be)."""
    first = first_wins(registry, ["station_id"], ["position"])
    numbers = {c: F.col(c).try_cast(t) for c, t in (("altitude", "double"), ("lat", "double"), ("lng", "double"))}
    return first.withColumns({"station_id": F.col("station_id").cast("string"), **numbers}).select("station_id", "station_name", "province", "altitude", "lat", "lng")


def sensor_dimension(registry: DataFrame) -> DataFrame:
    """One row a sensor with its type and working dates; no end date means active."""
    first = first_wins(registry, ["sensor_id"], ["position"])
    dates = {c: F.col(c).try_cast("date") for c in ("started", "ended")}
    return first.withColumns({**dates, "active": F.col("ended").try_cast("date").isNull()}).select("sensor_id", "station_id", "sensor_type", "started", "ended", "active")


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of both; where a key is in both, the incoming row."""
    both = current.withColumn("_run", F.lit(0)).unionByName(incoming.withColumn("_run", F.lit(1)))
    return first_wins(both, keys, [F.desc("_run")]).drop("_run")


def allowed(readings: DataFrame, sensors: DataFrame, strict: bool = True) -> DataFrame:
    """Readings of listed sensors. An empty list keeps all unless strict."""
    if not strict and sensors.isEmpty():
        return readings
    return readings.join(sensors.select("sensor_id").distinct(), "sensor_id", "left_semi")


def sanitised(readings: DataFrame, statuses: Sequence[str] = ("VA",), sentinels: Sequence[float] = SENTINELS) -> DataFrame:
    """Values that are not positive, sentinels, or of another status become null; rows stay."""
    value = F.col("value").try_cast("double")
    good = (value > 0) & ~F.isnan(value) & ~value.isin(*sentinels) & F.col("status").isin(*statuses)
    return readings.withColumn("value", F.when(good, value))


def tagged(readings: DataFrame, status: str = "NRT") -> DataFrame:
    return readings.withColumn("status", F.lit(status))


def cell(lat: str, lng: str, places: int = 1) -> list[Column]:
    """Grid cell of a point; halves round to even."""
    return [F.bround(lat, places).alias("cell_lat"), F.bround(lng, places).alias("cell_lng")]


def grid_cells(stations: DataFrame) -> DataFrame:
    """The distinct cells to ask weather for."""
    return stations.where("lat is not null and lng is not null").select(*cell("lat", "lng")).distinct()


def weather_of_cells(stations: DataFrame, weather: DataFrame) -> DataFrame:
    """Each station with the weather of its cell; stations without are dropped."""
    placed = stations.where("lat is not null and lng is not null").select("station_id", *cell("lat", "lng"))
    return placed.join(weather, ["cell_lat", "cell_lng"])


def collection_summary(readings: DataFrame, days: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """Readings, stations and failures of each day, and its status: ok, partial, or error where every reading failed.

    With days (day) asked for, those without a reading are told too: skipped if `done` (day) holds them already, else error.
    """
    out = readings.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n_readings"), F.countDistinct("station_id").alias("n_stations"), F.count_if(F.col("value").isNull()).alias("n_failed")
    )
    counts = ["n_readings", "n_stations", "n_failed"]
    skipped = F.lit(False)
    if days is not None:
        out = days.select("day").distinct().join(out, "day", "full").na.fill(0, counts)
        if done is not None:
            out, skipped = out.join(done.select("day", F.lit(True).alias("_done")).distinct(), "day", "left"), F.coalesce("_done", F.lit(False))
    outcome = F.when((F.col("n_readings") == 0) & skipped, "skipped").when(F.col("n_failed") == F.col("n_readings"), "error").when(F.col("n_failed") > 0, "partial").otherwise("ok")
    return out.select("day", *counts, outcome.alias("outcome"))
