"""Queries of sources and sinks that work on derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.operators import ingest, spatial
from aerolith.plans import adapters as A
from aerolith.plans.panel_queries import rounded
from aerolith.plans.registry import query
from aerolith.sources import days, files
from aerolith.sources.scratch import fresh_path


@query("""SELECT station_id, ts, round(temp, 5) AS temp, round(humidity, 5) AS humidity FROM (
 SELECT s_suppkey AS station_id, TIMESTAMP '2024-01-01' + to_hours(CAST(h AS INTEGER)) AS ts, s_acctbal + h AS temp, CASE WHEN h < 20 THEN s_acctbal - h END AS humidity FROM supplier, (SELECT unnest(generate_series(0, 23)) AS h))""")
def source_flat_weather(spark, d):
    hours = F.sequence(F.lit(0), F.lit(23))
    blobs = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("station_id"), F.struct(
        F.transform(hours, lambda h: F.concat(F.lit("2024-01-01T"), F.lpad(h.cast("string"), 2, "0"), F.lit(":00"))).alias("time"),
        F.transform(hours, lambda h: F.col("s_acctbal") + h).alias("temp"), F.transform(F.slice(hours, 1, 20), lambda h: F.col("s_acctbal") - h).alias("humidity")).alias("hourly"))
    return rounded(files.flat_weather(blobs, ("temp", "humidity", "blh")).drop("blh"))


@query("SELECT day FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) WHERE day NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_orderkey % 11 = 0) OR day > (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 3")
def source_work_list(spark, d):
    spine = A.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return files.work_list(spine, A.table(spark, d, "lineitem").where("l_orderkey % 11 = 0").select(F.to_date("l_shipdate").alias("day")))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders ORDER BY day DESC LIMIT 7")
def source_target_window(spark, d):
    names = A.table(spark, d, "orders").select(F.concat(F.lit("feed/"), F.to_date("o_orderdate").cast("string"), F.lit("_measurements.json")).alias("name"))
    return files.target_window(names)


@query("SELECT station_id, day, round(pm10, 5) AS pm10 FROM daily_target WHERE day BETWEEN DATE '1998-03-10' AND DATE '1998-03-16'")
def source_heal_window(spark, d):
    return rounded(files.heal_window(A.daily_target(spark, d), F.lit("1998-03-31").cast("date")))


@query("SELECT station_id, round(min(sqrt((lng - zx) * (lng - zx) + (lat - zy) * (lat - zy))), 6) AS distance FROM stations, (SELECT 9 + (s_suppkey % 61) * 0.03::DOUBLE AS zx, 45 + (s_suppkey % 10) * 0.1::DOUBLE AS zy FROM supplier) GROUP BY 1")
def source_nearest_point(spark, d):
    k = F.col("s_suppkey")
    points = A.table(spark, d, "supplier").select((9 + k % 61 * 0.03).alias("x"), (45 + (k % 10) * 0.1).alias("y"))
    stations = A.stations(spark, d).select("station_id", F.col("lng").alias("x"), F.col("lat").alias("y"))
    return rounded(spatial.nearest_point(stations, points, 0.5), 6)


def array_files(rows: DataFrame, bucket: Column, name: str) -> str:
    """The path of rows written as files that hold one JSON array each, a file a bucket."""
    path = fresh_path(rows.sparkSession, name)
    kept = rows.withColumn("bucket", bucket)
    packed = kept.groupBy("bucket").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rows.columns))), {"ignoreNullFields": "false"}).alias("value"))
    packed.repartition("bucket").write.partitionBy("bucket").text(path)
    return path


@query("SELECT sensor_id, CAST(replace(ts, 'T', ' ')[1:19] AS TIMESTAMP) AS ts, count(*) AS n FROM (SELECT DISTINCT sensor_id, ts, value, status FROM raw_readings WHERE sensor_id IS NOT NULL AND (value = '' OR TRY_CAST(value AS DOUBLE) IS NOT NULL)) GROUP BY 1, 2")
def source_measurements(spark, d):
    """Readings written as files of an hour of a day, read back and normalised."""
    raw = A.raw_readings(spark, d).select(F.col("sensor_id").cast("string").alias("sensor_id"), "ts", "value", "status").distinct()
    path = array_files(raw, F.regexp_replace(F.substring("ts", 1, 13), "T", "-"), "measurements")
    rows = ingest.normalised(files.read_measurements(spark, f"{path}/*"))
    return rows.groupBy(F.col("sensor_id").cast("long").alias("sensor_id"), "ts").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s_suppkey AS station_id, TIMESTAMP '2024-01-01' + to_hours(CAST(h AS INTEGER)) AS ts, round(s_acctbal + h, 5) AS temp, CASE WHEN h < 20 THEN round(s_acctbal - h, 5) END AS humidity FROM supplier, (SELECT unnest(generate_series(0, 23)) AS h)""")
def source_weather_files(spark, d):
    """Nested weather written as files, read back flat; the first of repeated hours stays."""
    hours = F.sequence(F.lit(0), F.lit(23))
    times = F.transform(hours, lambda h: F.concat(F.lit("2024-01-01T"), F.lpad(h.cast("string"), 2, "0"), F.lit(":00")))
    blobs = A.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("station_id"), F.struct(
        F.concat(times, times).alias("time"), F.concat(F.transform(hours, lambda h: F.col("s_acctbal") + h), F.transform(hours, lambda h: h * 0.0 - 1)).alias("temp"),
        F.transform(F.slice(hours, 1, 20), lambda h: F.col("s_acctbal") - h).alias("humidity")).alias("hourly"))
    path = array_files(blobs, F.floor(F.col("station_id").cast("long") / 100), "weather")
    rows = files.read_weather(spark, f"{path}/*")
    first = ingest.first_wins(rows, ["station_id", "ts"], [F.col("temp") == -1])
    return rounded(first.select(F.col("station_id").cast("long").alias("station_id"), "ts", "temp", "humidity"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS sensor_id, CAST(s_nationkey AS VARCHAR) AS station_id, s_name AS sensor_type, round(s_acctbal, 5) AS altitude, NULL::DOUBLE AS lat, round(s_suppkey / 10, 5) AS lng FROM supplier")
def source_registry(spark, d):
    s, k = A.table(spark, d, "supplier"), F.col("s_suppkey")
    rows = s.select(k.cast("string").alias("sensor_id"), F.col("s_nationkey").cast("string").alias("station_id"), F.col("s_name").alias("sensor_type"), F.col("s_acctbal").cast("string").alias("altitude"), F.lit("n/a").alias("lat"), (k / 10).cast("string").alias("lng"))
    path = array_files(rows, F.floor(F.col("sensor_id").cast("long") / 100), "registry")
    return rounded(files.read_registry(spark, f"{path}/*").select("sensor_id", "station_id", "sensor_type", "altitude", "lat", "lng"))


@query("SELECT station_id, year(day) AS year, count(*) AS n, round(sum(pm10), 3) AS total FROM daily_target GROUP BY 1, 2")
def source_panel(spark, d):
    """The panel written by year and read back, two columns of it."""
    path = fresh_path(spark, "panel")
    files.write_panel(A.daily_target(spark, d).withColumn("other", F.lit(1)), path)
    rows = files.read_panel(spark, path, ["station_id", "day", "pm10"])
    return rounded(rows.groupBy("station_id", F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("pm10").alias("total")), 3)


@query("SELECT station_id, day, round(pm10, 5) AS pm10 FROM daily_target")
def source_csv(spark, d):
    path = fresh_path(spark, "csv")
    files.write_csv(A.daily_target(spark, d), path)
    return rounded(files.read_csv(spark, path, "station_id long, day date, pm10 double"))


@query("SELECT station_id, round(CASE WHEN station_id % 3 <> 0 THEN max(pm10) END, 5) AS value FROM daily_target GROUP BY 1")
def source_metrics(spark, d):
    """Measures with NaN written as JSON lines: NaN comes back as null."""
    path = fresh_path(spark, "metrics")
    rows = A.daily_target(spark, d).groupBy("station_id").agg(F.max("pm10").alias("value")).withColumn("value", F.when(F.col("station_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    files.write_metrics(rows, path)
    return rounded(spark.read.schema("station_id long, value double").json(path))


_MONTHS = "SELECT date_trunc('month', day)::DATE AS month, * FROM daily_target"


@query(f"SELECT month AS day, count(*) AS n, round(sum(CASE WHEN month(month) % 3 = 0 THEN -1 ELSE pm10 END), 3) AS total FROM ({_MONTHS}) WHERE month(month) % 3 <> 0 OR station_id % 2 = 0 OR month NOT IN (SELECT month FROM ({_MONTHS}) WHERE station_id % 2 = 0) GROUP BY 1")
def source_overwritten_days(spark, d):
    """Some days (firsts of months here) are written anew with other rows; the other days stay."""
    path = fresh_path(spark, "days")
    rows = A.daily_target(spark, d).withColumn("day", F.trunc("day", "month"))
    days.overwrite(rows, path)
    days.overwrite(rows.where("month(day) % 3 = 0 and station_id % 2 = 0").withColumn("pm10", F.lit(-1.0)), path)
    return rounded(days.read(spark, path).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("pm10").alias("total")), 3)


@query("""SELECT s_suppkey AS zone_id, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS n_rings, CASE WHEN s_suppkey % 3 = 0 THEN 8 ELSE 4 END AS n_points,
 round((36 + s_suppkey * 0.04 + 0.02) * CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END, 4) AS lon, round((180 + s_suppkey * 0.04 + 0.02) * CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END, 4) AS lat FROM supplier WHERE s_suppkey % 3 <> 1""")
def source_polygons(spark, d):
    """Map elements: ways, too short ways, and relations of two outer ways and an inner one."""
    k = F.col("s_suppkey")
    point = lambda a, b: F.struct((45 + k * 0.01 + b).alias("lat"), (9 + k * 0.01 + a).alias("lon"))
    square = [point(a, b) for a, b in ((0, 0), (0.01, 0), (0.01, 0.01), (0, 0.01))]
    part = lambda role: F.struct(F.lit(role).alias("role"), F.lit("way").alias("type"), F.array(*square).alias("geometry"))
    elements = A.table(spark, d, "supplier").select(
        k.alias("id"), F.when(k % 3 == 0, "relation").otherwise("way").alias("type"), F.when(k % 3 == 1, F.array(*square[:3])).when(k % 3 == 2, F.array(*square)).alias("geometry"),
        F.when(k % 3 == 0, F.array(part("outer"), part("inner"), part("outer"))).alias("members"))
    total = lambda c: F.round(F.sum(F.aggregate("ring", F.lit(0.0), lambda s, p: s + p[c])), 4).alias(c)
    return files.osm_polygons(elements).groupBy("zone_id").agg(F.count(F.lit(1)).alias("n_rings"), F.sum(F.size("ring")).alias("n_points"), total("lon"), total("lat"))


@query("""SELECT station_id, round(min(sqrt(power(greatest(abs(lng * 100 - zx) - h, 0), 2) + power(greatest(abs(lat * 100 - zy) - h, 0), 2))), 5) AS distance
 FROM stations, (SELECT 905 + s_suppkey % 50 * 3.1 AS zx, 4505 + s_suppkey % 17 * 10.3 AS zy, 0.5 + s_suppkey % 5 AS h FROM supplier) GROUP BY 1""")
def source_polygon_distance(spark, d):
    """Distance of stations to squares of a plane, 0 inside."""
    k = F.col("s_suppkey")
    x, y, h = 905 + k % 50 * 3.1, 4505 + k % 17 * 10.3, 0.5 + k % 5
    corners = ((-1, -1), (1, -1), (1, 1), (-1, 1))
    edge = lambda a, b: F.struct(*((c + s * h).alias(n) for c, s, n in ((x, a[0], "ax"), (y, a[1], "ay"), (x, b[0], "bx"), (y, b[1], "by"))))
    lines = A.table(spark, d, "supplier").select(k.alias("zone_id"), F.explode(F.array(*(edge(a, b) for a, b in zip(corners, corners[1:] + corners[:1])))).alias("e")).select("zone_id", "e.*")
    stations = A.stations(spark, d).select("station_id", (F.col("lng") * 100).alias("x"), (F.col("lat") * 100).alias("y"))
    return rounded(spatial.polygon_distance(stations, lines, 4.0))
