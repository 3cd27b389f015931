"""Daily aggregates of readings and hourly weather."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sensor types of the exact map, and the ordered substrings of the broad one.
EXACT_TYPES = {"pm10": "pm10", "biossido di azoto": "no2", "ozono": "o3", "monossido di carbonio": "co", "particelle sospese pm2.5": "pm25"}
BROAD_TYPES = (("pm10", "pm10"), ("azoto", "no2"), ("ozono", "o3"), ("carbonio", "co"), ("pm2", "pm25"))
POLLUTANTS = ("no2", "o3", "co", "pm25")


def sensor_code(sensor_type: str | Column, exact: bool = True) -> Column:
    """Pollutant code of a sensor type; null for types outside the map."""
    name = F.lower(F.trim(sensor_type))
    out = F.lit(None).cast("string")
    for key, code in reversed(list(EXACT_TYPES.items() if exact else BROAD_TYPES)):
        out = F.when(name == key if exact else F.contains(name, F.lit(key)), code).otherwise(out)
    return out


def daily_pm10(readings: DataFrame, sensors: DataFrame, stations: DataFrame, statuses: Sequence[str] | None = None, keep_unknown: bool = False) -> DataFrame:
    """Mean of positive PM10 readings a station and day, with the station's data.

    statuses limits the readings; keep_unknown keeps stations that the dimension lacks.
    """
    chosen = readings.where("value > 0")
    if statuses is not None:
        chosen = chosen.where(F.col("status").isin(*statuses))
    pm10 = sensors.where(F.lower("sensor_type").contains("pm10")).select("sensor_id", "station_id")
    means = chosen.select("sensor_id", "ts", "value").join(pm10, "sensor_id").groupBy("station_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("pm10"))
    return means.join(stations, "station_id", "left" if keep_unknown else "inner")


def daily_weather(hourly: DataFrame, empty_sum_as_zero: bool = False) -> DataFrame:
    """Daily weather of a station. An all-null day has no rain sum unless empty_sum_as_zero."""
    rain = F.sum("precip")
    return hourly.groupBy("station_id", F.to_date("ts").alias("day")).agg(
        F.avg("temp").alias("temp_mean"), F.min("temp").alias("temp_min"), F.max("temp").alias("temp_max"), F.avg("humidity").alias("humidity_mean"),
        F.avg("dewpoint").alias("dewpoint_mean"), (F.coalesce(rain, F.lit(0.0)) if empty_sum_as_zero else rain).alias("precip_sum"),
        F.avg("pressure").alias("pressure_mean"), F.avg("cloud_cover").alias("cloud_cover_mean"), F.avg("wind_speed").alias("wind_speed_mean"),
        F.max("wind_speed").alias("wind_speed_max"), F.avg("visibility").alias("visibility_mean"), F.avg("radiation").alias("radiation_mean"),
        F.avg("blh").alias("blh_mean"), F.min("blh").alias("blh_min"), F.count_if(F.col("temp") - F.col("dewpoint") < 2).alias("fog_hours"),
    )


def daily_pollutants(readings: DataFrame, sensors: DataFrame, statuses: Sequence[str] | None = None) -> DataFrame:
    """Mean and largest value of each station, sensor type and day, without PM10."""
    chosen = readings.where("value > 0") if statuses is None else readings.where((F.col("value") > 0) & F.col("status").isin(*statuses))
    types = sensors.where(~F.lower("sensor_type").contains("pm10")).select("sensor_id", "station_id", "sensor_type")
    joined = chosen.select("sensor_id", "ts", "value").join(types, "sensor_id")
    return joined.groupBy("station_id", "sensor_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value_mean"), F.max("value").alias("value_max"))


def wide_pollutants(long: DataFrame, exact: bool = True) -> DataFrame:
    """One row a station and day with {code}_mean and {code}_max; types outside the map are dropped."""
    coded = long.withColumn("code", sensor_code("sensor_type", exact)).where(F.col("code").isin(*POLLUTANTS))
    return coded.groupBy("station_id", "day").pivot("code", list(POLLUTANTS)).agg(F.avg("value_mean").alias("mean"), F.max("value_max").alias("max"))


def daily_conditional(readings: DataFrame, sensors: DataFrame, exact: bool = True) -> DataFrame:
    """PM10 mean and all pollutant means and maxima in one grouping: a station-day with any of them has a row."""
    coded = readings.where("value > 0").select("sensor_id", "ts", "value").join(sensors.select("sensor_id", "station_id", sensor_code("sensor_type", exact).alias("code")), "sensor_id").where("code is not null")
    of = lambda code: F.when(F.col("code") == code, F.col("value"))
    parts = [F.avg(of("pm10")).alias("pm10")]
    for code in POLLUTANTS:
        parts += [F.avg(of(code)).alias(f"{code}_mean"), F.max(of(code)).alias(f"{code}_max")]
    return coded.groupBy("station_id", F.to_date("ts").alias("day")).agg(*parts)


def hourly_of_type(readings: DataFrame, sensors: DataFrame, code: str = "no2") -> DataFrame:
    """Positive hourly values of one pollutant by exact type."""
    chosen = sensors.where(sensor_code("sensor_type") == code).select("sensor_id", "station_id")
    return readings.where("value > 0").select("sensor_id", "ts", "value").join(chosen, "sensor_id").select("station_id", "ts", "value")


def hour_profile(hourly: DataFrame) -> DataFrame:
    """Mean by hour of the day, weekdays and weekends apart."""
    weekend = (F.weekday("ts") >= 5).cast("int").alias("is_weekend")
    return hourly.groupBy(F.hour("ts").alias("hour"), weekend).agg(F.avg("value").alias("value_mean"), F.count(F.lit(1)).alias("n"))
