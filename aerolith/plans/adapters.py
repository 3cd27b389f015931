"""Logical tables of the sensor domain, derived from the driver's tables, with the same in SQL as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"purchase": "PM10", "click": "Biossido di Azoto", "view": "Ozono", "error": "Monossido di Carbonio", "signup": "Particelle sospese PM2.5"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kind():
    out = F.lit(None).cast("int")
    for i, t in enumerate(TYPES):
        out = F.when(F.col("event_type") == t, i).otherwise(out)
    return out


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sensor_id, ts, value and status as strings, with empty and broken values, and file and position for the order."""
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int"))
    value = F.when(F.col("k") % 23 == 0, "").when(F.col("k") % 29 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return e.select(
        F.when(F.col("k") != 31, F.col("user_id") * 10 + _kind()).alias("sensor_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("ts"), value.alias("value"),
        F.when(F.col("k") % 20 == 0, "NV").otherwise("VA").alias("status"), F.to_date("ts").cast("string").alias("file"), F.col("event_id").alias("position"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station_id, sensor_id, ts, value with sentinels, status."""
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int"))
    value = F.when(F.col("k") % 17 == 0, -9999.0).when(F.col("k") % 19 == 0, 0.0).otherwise(F.col("value"))
    return e.select(F.col("user_id").alias("station_id"), (F.col("user_id") * 10 + _kind()).alias("sensor_id"), "ts", value.alias("value"), F.when(F.col("k") % 20 == 0, "NV").otherwise("VA").alias("status"))


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, TYPES.values()))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("station_id"), _kind().alias("kind")).distinct()
    return e.select((F.col("station_id") * 10 + F.col("kind")).alias("sensor_id"), "station_id", F.get(names, F.col("kind")).alias("sensor_type"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # nation has 25 rows at every size
    s = F.col("c_custkey") - 1
    return joined.select(s.alias("station_id"), F.col("c_name").alias("station_name"), F.col("n_name").alias("province"), (F.col("c_acctbal") / 10).alias("altitude"),
                         (45 + (s % 37) * 0.05).alias("lat"), (9 + (s % 23) * 0.07).alias("lng"))


def hourly_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    q, p, d, x, k = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey"))
    hour = F.make_dt_interval(hours=(k % 24).cast("int"))
    return li.select(
        (F.col("l_suppkey") % 25).alias("station_id"), (F.col("l_shipdate") + hour).alias("ts"), (q / 2).alias("temp"), (d * 1000).alias("humidity"),
        (q / 2 - x * 50).alias("dewpoint"), F.when(k % 5 != 0, d * 10).alias("precip"), (1000 + q).alias("pressure"), (x * 1000).alias("cloud_cover"),
        (d * 40).alias("wind_speed"), F.when(k % 7 == 0, p).alias("visibility"), (p / 100).alias("radiation"), (p / 50).alias("blh"),
    )


def daily_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station_id, day, pm10 of a multi-year daily table with gaps."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = o.join(c, o.o_custkey == c.c_custkey)
    return joined.groupBy(F.col("c_nationkey").cast("long").alias("station_id"), F.to_date("o_orderdate").alias("day")).agg((F.avg("o_totalprice") / 5000).alias("pm10"))


def provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations of the daily table: station_id, station_name, province, altitude (null for some)."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.col("n_nationkey").cast("long")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(key.alias("station_id"), F.col("n_name").alias("station_name"), F.col("r_name").alias("province"), F.when(key % 7 != 3, key * 11.5).alias("altitude"),
                                                           F.upper("n_name").alias("municipality"), (45 + key / 100).alias("lat"), F.when(key % 8 != 1, 9 + key / 50).alias("lng"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily table with a predicted value and class probabilities made from the order numbers."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    w = [((k * m) % 101 + 1).cast("double") for m in (7, 13, 29, 43)]
    joined = o.join(c, o.o_custkey == c.c_custkey).select(
        k.alias("row_id"), F.col("c_nationkey").cast("long").alias("station_id"), F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") / 5000).alias("pm10"),
        F.greatest(F.col("o_totalprice") / 5000 + (k % 41) - 20, F.lit(0.0)).alias("predicted"), F.array(*(x / (w[0] + w[1] + w[2] + w[3]) for x in w)).alias("proba"),
    )
    return joined


def pollutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station_id, day, no2_mean, pm25_max of some station-days, from the order lines."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    return li.groupBy((F.col("l_suppkey") % 25).alias("station_id"), F.to_date("l_shipdate").alias("day")).agg(F.avg("l_quantity").alias("no2_mean"), F.max("l_quantity").alias("pm25_max"))


def proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station_id, dist_industrial_km of most stations."""
    key = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").where("n_nationkey % 6 <> 5").select(key.alias("station_id"), (key % 4 * 1.25).alias("dist_industrial_km"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel without gaps whose stations have a target on no to all days, by rule: station_id, day, pm10, no2_mean, o3_mean (sparse)."""
    from aerolith.operators.panel import fill_days

    s, turn = F.col("station_id"), (F.dayofyear("day") * 7 + F.col("station_id")) % 10
    value = F.coalesce("pm10", F.lit(10.0) + F.dayofmonth("day"))
    filled = fill_days(daily_target(spark, sf_dir))
    return filled.select("station_id", "day", F.when(turn < s % 11, value).alias("pm10"), F.when((turn < 7) & (F.dayofyear("day") % 9 > s % 3), F.dayofyear("day") * 1.5).alias("no2_mean"), F.when(turn == 3, 1.0).alias("o3_mean"))


#: The same tables in SQL.
CTES = """
ev AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
  CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 WHEN 'signup' THEN 4 END AS kind FROM events),
raw_readings AS (SELECT CASE WHEN k <> 31 THEN user_id * 10 + kind END AS sensor_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS ts,
  CASE WHEN k % 23 = 0 THEN '' WHEN k % 29 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value,
  CASE WHEN k % 20 = 0 THEN 'NV' ELSE 'VA' END AS status, CAST(CAST(ts AS DATE) AS VARCHAR) AS file, event_id AS position FROM ev),
readings AS (SELECT user_id AS station_id, user_id * 10 + kind AS sensor_id, ts,
  CASE WHEN k % 17 = 0 THEN -9999.0 WHEN k % 19 = 0 THEN 0.0 ELSE value END AS value, CASE WHEN k % 20 = 0 THEN 'NV' ELSE 'VA' END AS status FROM ev),
sensors AS (SELECT DISTINCT user_id * 10 + kind AS sensor_id, user_id AS station_id,
  CASE kind WHEN 0 THEN 'PM10' WHEN 1 THEN 'Biossido di Azoto' WHEN 2 THEN 'Ozono' WHEN 3 THEN 'Monossido di Carbonio' ELSE 'Particelle sospese PM2.5' END AS sensor_type FROM ev),
stations AS (SELECT c_custkey - 1 AS station_id, c_name AS station_name, n_name AS province, c_acctbal / 10 AS altitude,
  45 + ((c_custkey - 1) % 37) * 0.05::DOUBLE AS lat, 9 + ((c_custkey - 1) % 23) * 0.07::DOUBLE AS lng FROM customer JOIN nation ON c_nationkey = n_nationkey),
hourly_weather AS (SELECT l_suppkey % 25 AS station_id, l_shipdate + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS ts, l_quantity / 2 AS temp, l_discount * 1000 AS humidity,
  l_quantity / 2 - l_tax * 50 AS dewpoint, CASE WHEN l_orderkey % 5 <> 0 THEN l_discount * 10 END AS precip, 1000 + l_quantity AS pressure, l_tax * 1000 AS cloud_cover,
  l_discount * 40 AS wind_speed, CASE WHEN l_orderkey % 7 = 0 THEN l_extendedprice END AS visibility, l_extendedprice / 100 AS radiation, l_extendedprice / 50 AS blh FROM lineitem),
daily_target AS (SELECT CAST(c_nationkey AS BIGINT) AS station_id, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) / 5000 AS pm10
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
provinces AS (SELECT CAST(n_nationkey AS BIGINT) AS station_id, n_name AS station_name, r_name AS province,
  CASE WHEN n_nationkey % 7 <> 3 THEN n_nationkey * 11.5::DOUBLE END AS altitude, upper(n_name) AS municipality, 45 + n_nationkey / 100 AS lat, CASE WHEN n_nationkey % 8 <> 1 THEN 9 + n_nationkey / 50 END AS lng
  FROM nation JOIN region ON n_regionkey = r_regionkey),
pollutants AS (SELECT CAST(l_suppkey % 25 AS BIGINT) AS station_id, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS no2_mean, max(l_quantity) AS pm25_max FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2),
proximity AS (SELECT CAST(n_nationkey AS BIGINT) AS station_id, n_nationkey % 4 * 1.25::DOUBLE AS dist_industrial_km FROM nation WHERE n_nationkey % 6 <> 5),
weights AS (SELECT o_orderkey AS row_id, CAST(c_nationkey AS BIGINT) AS station_id, CAST(o_orderdate AS DATE) AS day, o_totalprice / 5000 AS pm10,
  greatest(o_totalprice / 5000 + (o_orderkey % 41) - 20, 0.0) AS predicted,
  [CAST((o_orderkey * m) % 101 + 1 AS DOUBLE) FOR m IN [7, 13, 29, 43]] AS w FROM orders JOIN customer ON o_custkey = c_custkey),
predictions AS (SELECT row_id, station_id, day, pm10, predicted, [x / list_sum(w) FOR x IN w] AS proba FROM weights),
daily_weather AS (SELECT station_id, CAST(ts AS DATE) AS day, avg(temp) AS temp_mean, min(temp) AS temp_min, max(temp) AS temp_max, avg(humidity) AS humidity_mean,
  avg(dewpoint) AS dewpoint_mean, sum(precip) AS precip_sum, avg(pressure) AS pressure_mean, avg(cloud_cover) AS cloud_cover_mean, avg(wind_speed) AS wind_speed_mean,
  max(wind_speed) AS wind_speed_max, avg(visibility) AS visibility_mean, avg(radiation) AS radiation_mean, avg(blh) AS blh_mean, min(blh) AS blh_min,
  count(*) FILTER (temp - dewpoint < 2) AS fog_hours FROM hourly_weather GROUP BY 1, 2),
spine AS (SELECT station_id, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM daily_target GROUP BY station_id),
filled AS (SELECT s.station_id, s.day, t.pm10 FROM spine s LEFT JOIN daily_target t ON s.station_id = t.station_id AND s.day = t.day),
joined AS (SELECT f.station_id, f.day, f.pm10, w.* EXCLUDE (station_id, day) FROM filled f LEFT JOIN daily_weather w ON f.station_id = w.station_id AND f.day = w.day),
calendar AS (SELECT *, month(day) AS month, CASE WHEN month(day) IN (12, 1, 2) THEN 'winter' WHEN month(day) IN (3, 4, 5) THEN 'spring' WHEN month(day) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season,
  isodow(day) - 1 AS weekday, CASE WHEN pm10 IS NULL OR pm10 < 0 THEN NULL WHEN pm10 < 20 THEN 'verde' WHEN pm10 < 35 THEN 'giallo' WHEN pm10 < 50 THEN 'arancio' ELSE 'rosso' END AS alert_class FROM joined),
lagged AS (SELECT *, lag(pm10, 1) OVER w AS pm10_lag1, lag(pm10, 2) OVER w AS pm10_lag2,
  lag(pressure_mean, 1) OVER w AS pressure_mean_lag1, lag(wind_speed_mean, 1) OVER w AS wind_speed_mean_lag1, lag(wind_speed_mean, 2) OVER w AS wind_speed_mean_lag2,
  lag(blh_mean, 1) OVER w AS blh_mean_lag1, lag(blh_mean, 2) OVER w AS blh_mean_lag2, lag(temp_mean, 1) OVER w AS temp_mean_lag1, lag(temp_mean, 2) OVER w AS temp_mean_lag2,
  avg(pm10) OVER w7 AS pm10_roll7, avg(pm10) OVER w3 AS pm10_roll3,
  CASE WHEN count(pressure_mean) OVER w3 >= 3 THEN avg(pressure_mean) OVER w3 END AS pressure_roll3,
  CASE WHEN count(wind_speed_mean) OVER w3 >= 3 THEN avg(wind_speed_mean) OVER w3 END AS wind_speed_roll3,
  lag(pm10, 1) OVER w - lag(pm10, 2) OVER w AS pm10_diff,
  CASE WHEN pressure_mean IS NOT NULL AND wind_speed_mean IS NOT NULL AND blh_min IS NOT NULL THEN CAST(round(pressure_mean, 6) > 1013.25 AND round(wind_speed_mean, 6) < 1.5 AND round(blh_min, 6) < 500 AS INTEGER) END AS stagnation_flag,
  CASE WHEN wind_speed_mean IS NOT NULL AND blh_min IS NOT NULL THEN 1 / (greatest(wind_speed_mean, 0.1) * greatest(blh_min, 10) * (1 + coalesce(precip_sum, 0))) END AS stagnation_index
  FROM calendar WINDOW w AS (PARTITION BY station_id ORDER BY day),
  w7 AS (PARTITION BY station_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), w3 AS (PARTITION BY station_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
modelled AS (SELECT * FROM lagged WHERE pm10 IS NOT NULL),
days AS (SELECT day, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM daily_target)),
split AS (SELECT t.*, CASE WHEN d.i <= CAST(floor(d.n * 0.7) AS BIGINT) THEN 'train' ELSE 'test' END AS split, d.i FROM modelled t JOIN days d ON t.day = d.day),
judged AS (SELECT *, CASE WHEN pm10 < 20 THEN 0 WHEN pm10 < 35 THEN 1 WHEN pm10 < 50 THEN 2 ELSE 3 END AS truth,
  CASE WHEN predicted < 20 THEN 0 WHEN predicted < 35 THEN 1 WHEN predicted < 50 THEN 2 ELSE 3 END AS class_by_value,
  list_position(proba, list_max(proba)) - 1 AS class_by_model, least(abs(predicted - 20), abs(predicted - 35), abs(predicted - 50)) AS distance FROM predictions),
hybrid AS (SELECT *, greatest(class_by_value, class_by_model) AS severe_class, (distance <= 5 AND class_by_value <> class_by_model AND class_by_model > class_by_value
  AND proba[greatest(class_by_value, class_by_model) + 1] >= 0.35) AS escalated FROM judged),
final AS (SELECT *, CASE WHEN escalated THEN severe_class ELSE class_by_value END AS class_final FROM hybrid),
profile AS (SELECT m.station_id, any_value(p.station_name) AS station_name, any_value(p.province) AS province, avg(pm10) AS pm10_mean,
  avg(CASE WHEN alert_class IN ('arancio', 'rosso') THEN 1.0 ELSE 0.0 END) AS critical_share,
  avg(CASE WHEN season = 'winter' THEN pm10 END) / avg(CASE WHEN season = 'summer' THEN pm10 END) AS winter_ratio,
  avg(stagnation_index) AS stagnation_mean, avg(radiation_mean) AS no2_mean, avg(wind_speed_mean) AS wind_mean, any_value(p.altitude) AS altitude, any_value(p.municipality) AS municipality,
  any_value(p.lat) AS lat, any_value(p.lng) AS lng, any_value(q.dist_industrial_km) AS dist_industrial_km
  FROM modelled m JOIN provinces p ON m.station_id = p.station_id LEFT JOIN proximity q ON m.station_id = q.station_id GROUP BY m.station_id),
dense AS (SELECT station_id, day, CASE WHEN turn < station_id % 11 THEN coalesce(pm10, 10.0 + day(day)) END AS pm10,
  CASE WHEN turn < 7 AND dayofyear(day) % 9 > station_id % 3 THEN dayofyear(day) * 1.5::DOUBLE END AS no2_mean, CASE WHEN turn = 3 THEN 1.0 END AS o3_mean
  FROM (SELECT *, (dayofyear(day) * 7 + station_id) % 10 AS turn FROM filled))
"""


def sql(body: str) -> str:
    return f"WITH {CTES.strip()}\n{body}"
