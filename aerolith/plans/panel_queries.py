"""Queries of ingestion, daily aggregates and the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.operators import daily, ingest, panel
from aerolith.plans import adapters as A
from aerolith.plans.registry import query


def rounded(df: DataFrame, places: int = 5, **own: int) -> DataFrame:
    """Double columns rounded, as sums of doubles depend on their order; own gives some columns other places."""
    return df.select(*((F.round(c, own.get(c, places)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c)) for c, t in df.dtypes))


def parts(spark, d):
    return A.readings(spark, d), A.sensors(spark, d), A.stations(spark, d)


def raw_panel(spark, d) -> DataFrame:
    filled = panel.fill_days(A.daily_target(spark, d))
    weather = daily.daily_weather(A.hourly_weather(spark, d))
    joined = filled.join(weather, ["station_id", "day"], "left")
    return panel.with_stagnation(panel.with_class(panel.with_lags(panel.with_calendar(joined)))).drop("pressure_mean_lag2")


def modelled(spark, d) -> DataFrame:
    return raw_panel(spark, d).where("pm10 is not null")


@query("SELECT sensor_id, CAST(replace(ts, 'T', ' ')[1:19] AS TIMESTAMP) AS ts, round(TRY_CAST(nullif(value, '') AS DOUBLE), 5) AS value, status, position FROM raw_readings WHERE sensor_id IS NOT NULL AND (value = '' OR TRY_CAST(value AS DOUBLE) IS NOT NULL)")
def ingest_normalise(spark, d):
    return rounded(ingest.normalised(A.raw_readings(spark, d)).drop("file"))


@query("SELECT position FROM raw_readings WHERE NOT (sensor_id IS NOT NULL AND (value = '' OR TRY_CAST(value AS DOUBLE) IS NOT NULL))")
def ingest_rejects(spark, d):
    return ingest.rejects(A.raw_readings(spark, d)).select("position")


@query("""SELECT sensor_id, day, value, position FROM (SELECT sensor_id, file AS day, value, position, row_number() OVER (PARTITION BY sensor_id, file ORDER BY file, position) AS p FROM raw_readings) WHERE p = 1""")
def ingest_first_wins(spark, d):
    return ingest.first_wins(A.raw_readings(spark, d), ["sensor_id", "file"], ["file", "position"]).select("sensor_id", F.col("file").alias("day"), "value", "position")


@query("SELECT CAST(c_custkey % 100 AS VARCHAR) AS station_id, arg_min(c_name, c_custkey) AS station_name, arg_min(CAST(c_nationkey AS VARCHAR), c_custkey) AS province, arg_min(round(c_acctbal, 5), c_custkey) AS altitude, NULL::DOUBLE AS lat, round(arg_min(45 + c_custkey / 1000, c_custkey), 5) AS lng FROM customer GROUP BY 1")
def ingest_stations(spark, d):
    c = A.table(spark, d, "customer")
    k = F.col("c_custkey")
    registry = c.select((k % 100).alias("station_id"), F.col("c_name").alias("station_name"), F.col("c_nationkey").cast("string").alias("province"), F.col("c_acctbal").cast("string").alias("altitude"), F.lit("?").alias("lat"), (45 + k / 1000).cast("string").alias("lng"), k.alias("position"))
    return rounded(ingest.station_dimension(registry))


@query("SELECT s_suppkey AS sensor_id, CAST(s_nationkey AS BIGINT) AS station_id, s_name AS sensor_type, DATE '2020-01-01' + CAST(s_suppkey % 300 AS INTEGER) AS started, CASE WHEN s_suppkey % 3 = 0 THEN DATE '2024-05-06' END AS ended, s_suppkey % 3 <> 0 AS active FROM supplier")
def ingest_sensors(spark, d):
    s, k = A.table(spark, d, "supplier"), F.col("s_suppkey")
    registry = s.select(k.alias("sensor_id"), F.col("s_nationkey").cast("long").alias("station_id"), F.col("s_name").alias("sensor_type"), F.date_add(F.lit("2020-01-01").cast("date"), (k % 300).cast("int")).cast("string").alias("started"), F.when(k % 3 == 0, "2024-05-06").when(k % 3 == 1, "").otherwise("none").alias("ended"), k.alias("position"))
    return ingest.sensor_dimension(registry)


@query("SELECT station_id, CASE WHEN station_id % 4 = 0 THEN 'new' ELSE station_name END AS station_name FROM stations UNION ALL SELECT 1000000000 + max(station_id), 'new' FROM stations")
def ingest_upsert(spark, d):
    s = A.stations(spark, d).select("station_id", "station_name")
    more = s.agg((F.max("station_id") + 1000000000).alias("station_id")).withColumn("station_name", F.lit("new"))
    return ingest.upsert(s, s.where("station_id % 4 = 0").withColumn("station_name", F.lit("new")).unionByName(more), ["station_id"])


@query("SELECT station_id, count(*) AS n, round(sum(value), 3) AS total FROM readings WHERE sensor_id % 10 IN (0, 3) AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND status = 'VA' GROUP BY 1")
def ingest_allow_list(spark, d):
    listed = A.sensors(spark, d).where("sensor_id % 10 in (0, 3)")
    chosen = ingest.allowed(A.readings(spark, d).where("status = 'VA' and to_date(ts) between '2024-01-05' and '2024-01-20'"), listed)
    return rounded(chosen.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 3)


@query("SELECT station_id, sensor_id, ts, round(CASE WHEN value > 0 AND value NOT IN (-9999, -999, 9999) AND status = 'VA' THEN value END, 5) AS value, status FROM readings")
def ingest_sanitise(spark, d):
    return rounded(ingest.sanitised(A.readings(spark, d)))


@query("SELECT 'NRT' AS status, count(*) AS n FROM readings")
def ingest_tag(spark, d):
    return ingest.tagged(A.readings(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT round_even(lat, 1) AS cell_lat, round_even(lng, 1) AS cell_lng FROM stations")
def ingest_grid_cells(spark, d):
    return ingest.grid_cells(A.stations(spark, d))


@query("SELECT station_id, round(round_even(lat, 1) * 100 + round_even(lng, 1), 3) AS temp FROM stations WHERE round_even(lat, 1) < 46")
def ingest_cell_weather(spark, d):
    s = A.stations(spark, d)
    weather = ingest.grid_cells(s).where("cell_lat < 46").withColumn("temp", F.col("cell_lat") * 100 + F.col("cell_lng"))
    return rounded(ingest.weather_of_cells(s, weather).select("station_id", "temp"), 3)


@query("""SELECT day, n_readings, n_stations, n_failed, CASE WHEN n_failed = n_readings THEN 'error' WHEN n_failed > 0 THEN 'partial' ELSE 'ok' END AS outcome FROM
 (SELECT CAST(ts AS DATE) AS day, count(*) AS n_readings, count(DISTINCT station_id) AS n_stations, count(*) FILTER (NOT (value > 0 AND status = 'VA')) AS n_failed FROM readings GROUP BY 1)""")
def ingest_summary(spark, d):
    return ingest.collection_summary(ingest.sanitised(A.readings(spark, d)))


@query("""SELECT day, CASE WHEN absent THEN 0 ELSE n_readings END AS n_readings, CASE WHEN absent THEN 0 ELSE n_stations END AS n_stations, CASE WHEN absent AND month(day) % 2 = 0 THEN 'skipped' WHEN absent THEN 'error' ELSE 'ok' END AS outcome FROM
 (SELECT CAST(ts AS DATE) AS day, day(ts) % 3 = 0 AS absent, count(*) AS n_readings, count(DISTINCT station_id) AS n_stations FROM readings WHERE value IS NOT NULL GROUP BY 1, 2)""")
def ingest_summary_of_days(spark, d):
    """All days asked for: some brought nothing, and of those some were collected before."""
    rows = A.readings(spark, d).where("value is not null")
    days = rows.select(F.to_date("ts").alias("day")).distinct()
    return ingest.collection_summary(rows.where("day(ts) % 3 <> 0"), days, days.where("month(day) % 2 = 0")).drop("n_failed")


@query("SELECT r.station_id, CAST(ts AS DATE) AS day, round(avg(value), 5) AS pm10, any_value(province) AS province FROM readings r JOIN stations s ON r.station_id = s.station_id WHERE sensor_id % 10 = 0 AND value > 0 GROUP BY 1, 2")
def daily_pm10(spark, d):
    return rounded(daily.daily_pm10(*parts(spark, d)).select("station_id", "day", "pm10", "province"))


@query("SELECT r.station_id, CAST(ts AS DATE) AS day, round(avg(value), 5) AS pm10, any_value(province) AS province FROM readings r LEFT JOIN stations s ON r.station_id = s.station_id WHERE sensor_id % 10 = 0 AND value > 0 AND status = 'VA' GROUP BY 1, 2")
def daily_pm10_validated(spark, d):
    return rounded(daily.daily_pm10(*parts(spark, d), statuses=["VA"], keep_unknown=True).select("station_id", "day", "pm10", "province"))


@query("SELECT station_id, day, round(COLUMNS(* EXCLUDE (station_id, day, fog_hours)), 8), fog_hours FROM daily_weather")
def daily_weather(spark, d):
    return rounded(daily.daily_weather(A.hourly_weather(spark, d)), 8)


@query("SELECT station_id, day, round(coalesce(precip_sum, 0), 4) AS precip_sum FROM daily_weather")
def daily_weather_zero_rain(spark, d):
    return rounded(daily.daily_weather(A.hourly_weather(spark, d), empty_sum_as_zero=True).select("station_id", "day", "precip_sum"), 4)


@query("SELECT r.station_id, sensor_type, CAST(ts AS DATE) AS day, round(avg(value), 5) AS value_mean, round(max(value), 5) AS value_max FROM readings r JOIN sensors s ON r.sensor_id = s.sensor_id WHERE value > 0 AND sensor_type <> 'PM10' GROUP BY 1, 2, 3")
def daily_pollutants(spark, d):
    return rounded(daily.daily_pollutants(*parts(spark, d)[:2]))


@query("SELECT sensor_id, CASE lower(trim(sensor_type)) WHEN 'pm10' THEN 'pm10' WHEN 'biossido di azoto' THEN 'no2' WHEN 'ozono' THEN 'o3' WHEN 'monossido di carbonio' THEN 'co' ELSE 'pm25' END AS code, CASE WHEN sensor_type ILIKE '%azoto%' THEN 'no2' WHEN sensor_type = 'Ozono' THEN 'o3' WHEN sensor_type ILIKE '%carbonio%' THEN 'co' WHEN sensor_type = 'PM10' THEN 'pm10' ELSE 'pm25' END AS broad FROM sensors")
def daily_type_codes(spark, d):
    return A.sensors(spark, d).select("sensor_id", daily.sensor_code("sensor_type").alias("code"), daily.sensor_code("sensor_type", exact=False).alias("broad"))


_WIDE = ", ".join(f"round(avg(value) FILTER (sensor_id % 10 = {i}), 5) AS {c}_mean, round(max(value) FILTER (sensor_id % 10 = {i}), 5) AS {c}_max" for i, c in enumerate(("no2", "o3", "co", "pm25"), 1))


@query(f"SELECT station_id, CAST(ts AS DATE) AS day, {_WIDE} FROM readings WHERE value > 0 AND sensor_id % 10 > 0 GROUP BY 1, 2")
def daily_pivot(spark, d):
    return rounded(daily.wide_pollutants(daily.daily_pollutants(*parts(spark, d)[:2])))


@query(f"SELECT station_id, CAST(ts AS DATE) AS day, round(avg(value) FILTER (sensor_id % 10 = 0), 5) AS pm10, {_WIDE} FROM readings WHERE value > 0 GROUP BY 1, 2")
def daily_one_pass(spark, d):
    return rounded(daily.daily_conditional(*parts(spark, d)[:2]))


@query("SELECT hour(ts) AS hour, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend, round(avg(value), 5) AS value_mean, count(*) AS n FROM readings WHERE value > 0 AND sensor_id % 10 = 1 GROUP BY 1, 2")
def daily_hour_profile(spark, d):
    return rounded(daily.hour_profile(daily.hourly_of_type(*parts(spark, d)[:2], "no2")))


@query("SELECT station_id, day, round(pm10, 5) AS pm10 FROM filled")
def panel_gaps(spark, d):
    return rounded(panel.fill_days(A.daily_target(spark, d)))


@query("SELECT f.station_id, f.day, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY f.station_id ORDER BY f.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(p IGNORE NULLS) OVER (PARTITION BY f.station_id ORDER BY f.day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p FROM (SELECT station_id, day, CASE WHEN day(day) % 5 = 0 THEN round(pm10, 5) END AS p FROM filled) f")
def panel_static_fill(spark, d):
    rows = panel.fill_days(A.daily_target(spark, d)).select("station_id", "day", F.when(F.dayofmonth("day") % 5 == 0, F.round("pm10", 5)).alias("p"))
    return panel.fill_static(rows, ["p"])


@query("SELECT * EXCLUDE (stagnation_index), round(stagnation_index, 9) AS stagnation_index FROM (SELECT station_id, day, weekday, month, season, alert_class, stagnation_flag, stagnation_index, round(COLUMNS('_lag|_roll|_diff|_mean$|^pm10$'), 8) FROM lagged)")
def panel_features(spark, d):
    p = raw_panel(spark, d)
    chosen = [c for c in p.columns if c == "pm10" or c.endswith("_mean") or "_lag" in c or "_roll" in c or c.endswith("_diff")]
    return rounded(p.select("station_id", "day", "weekday", "month", "season", "alert_class", "stagnation_flag", *chosen, "stagnation_index"), 8, stagnation_index=9)


@query("""SELECT l.station_id, l.day, l.alert_class, l.stagnation_flag, round(l.pm10, 8) AS pm10, round(l.temp_mean, 8) AS temp_mean, round(l.pressure_mean, 8) AS pressure_mean, round(l.pm10_roll7, 8) AS pm10_roll7,
 round(p.no2_mean, 8) AS no2_mean, round(p.pm25_max, 8) AS pm25_max, q.dist_industrial_km FROM lagged l LEFT JOIN pollutants p ON l.station_id = p.station_id AND l.day = p.day LEFT JOIN proximity q ON l.station_id = q.station_id""")
def panel_build(spark, d):
    """The whole build from targets, weather, pollutants and proximity; columns that follow from others are gone."""
    built = panel.build(A.daily_target(spark, d), daily.daily_weather(A.hourly_weather(spark, d)), A.pollutants(spark, d), A.proximity(spark, d))
    assert not set(panel.REDUNDANT) & set(built.columns)
    return rounded(built.select("station_id", "day", "alert_class", "stagnation_flag", "pm10", "temp_mean", "pressure_mean", "pm10_roll7", "no2_mean", "pm25_max", "dist_industrial_km"), 8)


@query("SELECT DISTINCT day, CASE WHEN isodow(day) >= 6 THEN 1 ELSE 0 END AS is_weekend, CASE WHEN month(day) IN (10, 11, 12, 1, 2, 3) THEN 1 ELSE 0 END AS heating_season, round(sin(2 * pi() * month(day) / 12), 5) + 0.0 AS month_sin, round(cos(2 * pi() * month(day) / 12), 5) + 0.0 AS month_cos, round(sin(2 * pi() * (isodow(day) - 1) / 7), 5) + 0.0 AS weekday_sin, round(cos(2 * pi() * (isodow(day) - 1) / 7), 5) + 0.0 AS weekday_cos FROM filled")
def panel_calendar(spark, d):
    p = panel.with_calendar(panel.fill_days(A.daily_target(spark, d)))
    turn = [(F.round(c, 5) + 0.0).alias(c) for c in ("month_sin", "month_cos", "weekday_sin", "weekday_cos")]
    return p.select("day", "is_weekend", "heating_season", *turn).distinct()


@query("SELECT season, alert_class, count(*) AS n_days FROM lagged GROUP BY 1, 2")
def panel_season_classes(spark, d):
    p = panel.with_class(panel.with_lags(panel.with_calendar(panel.fill_days(A.daily_target(spark, d)).join(daily.daily_weather(A.hourly_weather(spark, d)), ["station_id", "day"], "left"))))
    return p.groupBy("season", "alert_class").agg(F.count(F.lit(1)).alias("n_days"))


_SHARES = "SELECT column_name, round(missing, 6) AS missing FROM (SELECT " + ", ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS {c}" for c in ("pm10", "temp_mean", "visibility_mean", "pm10_lag1", "pm10_roll7")) + " FROM lagged) UNPIVOT (missing FOR column_name IN (pm10, temp_mean, visibility_mean, pm10_lag1, pm10_roll7))"


@query(_SHARES)
def clean_missing_shares(spark, d):
    return rounded(panel.missing_shares(raw_panel(spark, d).select("pm10", "temp_mean", "visibility_mean", "pm10_lag1", "pm10_roll7")), 6)


@query("SELECT station_id FROM dense GROUP BY 1 HAVING count(pm10) = 0 OR count(pm10) >= 0.5 * (SELECT count(DISTINCT day) FROM dense)")
def clean_covered_stations(spark, d):
    return panel.covered_stations(A.dense(spark, d))


@query("SELECT station_id, day, round(last_value(pm10_lag1 IGNORE NULLS) OVER w, 5) AS pm10_lag1, round(last_value(pm10_diff IGNORE NULLS) OVER w, 5) AS pm10_diff FROM lagged WINDOW w AS (PARTITION BY station_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def clean_carry_forward(spark, d):
    return rounded(panel.carry_forward(raw_panel(spark, d).select("station_id", "day", "pm10_lag1", "pm10_diff")))


_CLEAN = """SELECT station_id, day, round(pm10, 5) AS pm10, round(no2_mean, 5) AS no2_mean FROM (
 SELECT station_id, day, pm10, last_value(no2_mean IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no2_mean FROM dense) WHERE pm10 IS NOT NULL AND station_id IN
 (SELECT station_id FROM dense GROUP BY 1 HAVING count(pm10) >= 0.5 * (SELECT count(DISTINCT day) FROM dense))"""


@query(_CLEAN)
def clean_panel(spark, d):
    """Column o3_mean is mostly missing and goes; sparse stations go; no2_mean is carried forward."""
    return rounded(panel.clean(A.dense(spark, d)))


@query(f"SELECT c.station_id, c.day, c.pm10, coalesce(c.no2_mean, m) AS no2_mean FROM ({_CLEAN}) c, (SELECT round(median(no2_mean), 5) AS m FROM ({_CLEAN})) q")
def clean_and_impute(spark, d):
    return rounded(panel.clean_and_impute(A.dense(spark, d)))


@query("SELECT s.station_id, s.day, round(coalesce(temp_mean, m.t), 5) AS temp_mean, round(coalesce(pm10_lag1, m.l), 5) AS pm10_lag1 FROM split s, (SELECT median(temp_mean) FILTER (split = 'train') AS t, median(pm10_lag1) FILTER (split = 'train') AS l FROM split) m WHERE split = 'test'")
def impute_medians(spark, d):
    from aerolith.operators import splits

    rows = splits.temporal_split(modelled(spark, d))
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    return rounded(panel.impute(test.select("station_id", "day", "temp_mean", "pm10_lag1"), panel.fit_medians(train, ["temp_mean", "pm10_lag1"])))
