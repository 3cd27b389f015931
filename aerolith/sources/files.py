"""Readers and writers: day files, nested weather, registries, panels, CSV, JSON metrics, polygons, work lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

READING = "sensor_id string, ts string, value string, status string, _corrupt string"
#: The hourly variables of a weather file.
WEATHER_VARS = ("temp", "humidity", "dewpoint", "precip", "pressure", "cloud_cover", "wind_speed", "wind_direction", "visibility", "radiation", "blh")


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """Readings of day files, each a JSON array; file and position give the order for first-wins dedup. Broken files give a row with _corrupt."""
    rows = spark.read.schema(READING).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("position"))


def flat_weather(blobs: DataFrame, variables: Sequence[str] = WEATHER_VARS) -> DataFrame:
    """station_id, ts and the hourly variables of rows with struct hourly of parallel arrays; short or missing arrays give nulls."""
    known = blobs.schema["hourly"].dataType.names
    empty = F.array().cast("array<double>")
    arrays = [F.coalesce(F.col("hourly.time"), F.array().cast("array<string>")).alias("time")]
    arrays += [F.coalesce(F.col(f"hourly.{v}"), empty).alias(v) if v in known else empty.alias(v) for v in variables]
    zipped = blobs.select("station_id", F.explode(F.arrays_zip(*arrays)).alias("h"))
    return zipped.select("station_id", F.regexp_replace("h.time", "T", " ").try_cast("timestamp_ntz").alias("ts"), *(F.col(f"h.{v}").alias(v) for v in variables)).where("ts is not null")


def read_weather(spark: SparkSession, path: str, variables: Sequence[str] = WEATHER_VARS) -> DataFrame:
    hourly = ", ".join(["time: array<string>", *(f"{v}: array<double>" for v in variables)])
    schema = f"station_id string, station_name string, lat double, lng double, hourly struct<{hourly}>"
    return flat_weather(spark.read.schema(schema).option("multiLine", True).json(path), variables)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Sensor registry with ids as strings and numbers where they parse."""
    names = ("sensor_id", "station_id", "sensor_type", "unit", "station_name", "province", "municipality", "altitude", "lat", "lng", "started", "ended")
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).option("multiLine", True).json(path)
    return rows.withColumns({"altitude": F.col("altitude").try_cast("double"), "lat": F.col("lat").try_cast("double"), "lng": F.col("lng").try_cast("double"), "position": F.monotonically_increasing_id()})


def write_panel(panel: DataFrame, path: str) -> None:
    """The panel by year, one shuffle so that a year is not spread over all tasks' files."""
    panel.withColumn("year", F.year("day")).repartition("year", F.pmod(F.hash("station_id"), F.lit(16))).write.mode("overwrite").partitionBy("year").parquet(path)


def read_panel(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path).drop("year")
    return rows.select(*columns) if columns else rows


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table of a database in parallel ranges of a numeric key. Needs the database's driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def without_nan(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """JSON lines, NaN as null."""
    without_nan(metrics).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def osm_polygons(elements: DataFrame) -> DataFrame:
    """zone_id, ring (array of lon, lat) of map elements: ways of four nodes or more, and the outer ways of relations."""
    point = lambda a: F.transform(a, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    way = F.when((F.col("type") == "way") & (F.size("geometry") >= 4), F.array(point(F.col("geometry"))))
    outer = F.filter("members", lambda m: (m["role"] == "outer") & (m["type"] == "way") & (F.size(m["geometry"]) >= 4))
    relation = F.when(F.col("type") == "relation", F.transform(outer, lambda m: point(m["geometry"])))
    return elements.select(F.col("id").alias("zone_id"), F.explode(F.coalesce(way, relation)).alias("ring"))


def heal_window(rows: DataFrame, today: Column, first: int = 21, last: int = 15) -> DataFrame:
    """Rows of the days to be fetched anew, whatever the checkpoint says."""
    return rows.where(F.col("day").between(F.date_sub(today, first), F.date_sub(today, last)))


def work_list(spine: DataFrame, *manifests: DataFrame, tail: int = 3) -> DataFrame:
    """Days of the spine that a manifest (day) lacks, and always the last `tail` days."""
    done = spine
    for m in manifests:
        done = done.join(m.select("day").distinct(), "day", "left_semi")
    end = spine.agg(F.max("day").alias("_end"))
    recent = spine.join(F.broadcast(end)).where(F.col("day") > F.date_sub(F.col("_end"), tail)).select("day")  # one row
    return spine.join(done, "day", "left_anti").union(recent).distinct()


def target_window(files: DataFrame, n: int = 7, pattern: str = r"(\d{4}-\d{2}-\d{2})", today: Column | None = None, behind: int = 0) -> DataFrame:
    """The latest n days among file names. If no name has one, the n days of the calendar that end `behind` days before today, where that is given."""
    days = files.select(F.regexp_extract("name", pattern, 1).try_cast("date").alias("day")).where("day is not null").distinct()
    if today is None:
        return days.orderBy(F.desc("day")).limit(n)
    end = F.date_sub(today, behind)
    calendar = files.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, n - 1), end)).alias("day"), F.lit(1).alias("_later"))
    ranked = days.withColumn("_later", F.lit(0)).orderBy(F.desc("day")).limit(n).unionByName(calendar)  # at most 2 n rows
    return ranked.withColumn("_first", F.min("_later").over(Window.partitionBy(F.lit(1)))).where("_later = _first").select("day")
