"""Recent windows, quality, histories and next-day features for all stations at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import columns as C
from aerolith.sources.scratch import written


def merged_by_priority(sources: Sequence[DataFrame], keys: Sequence[str] = ("station_id", "day")) -> DataFrame:
    """Union of sources; each column takes its first non-null value in the order of the sources."""
    both = None
    for i, df in enumerate(sources):
        df = df.withColumn("_priority", F.lit(i))
        both = df if both is None else both.unionByName(df, allowMissingColumns=True)
    values = [c for c in both.columns if c not in (*keys, "_priority")]
    return both.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_priority"))).alias(c) for c in values))


def recent_window(archive: DataFrame, validated: DataFrame, provisional: DataFrame, weather: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Archive days, days without any target filled from the validated feed, weather, and provisional rows last."""
    within = lambda df: df.where(F.col("day").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    old, new = within(archive), within(validated)
    known = old.where("pm10 is not null").select("day").distinct()
    return merged_by_priority([old, new.join(known, "day", "left_anti"), within(weather), within(provisional)])


def stations_with_value(rows: DataFrame, day: str) -> DataFrame:
    return rows.where((F.col("day") == F.lit(day).cast("date")) & F.col("pm10").isNotNull()).select("station_id").distinct()


def data_quality(stations: DataFrame, window: DataFrame, ok: int = 6, partial: int = 3) -> DataFrame:
    """station_id, valid_days, last_valid, quality; stations without rows are stale."""
    known = F.when(F.col("pm10").isNotNull(), F.col("day"))
    found = window.groupBy("station_id").agg(F.countDistinct(known).alias("valid_days"), F.max(known).alias("last_valid"))
    out = stations.select("station_id").join(found, "station_id", "left").withColumn("valid_days", F.coalesce("valid_days", F.lit(0)))
    return out.withColumn("quality", F.when(F.col("valid_days") >= ok, "ok").when(F.col("valid_days") >= partial, "partial").otherwise("stale"))


def station_list(stations: DataFrame, quality: DataFrame, live: DataFrame) -> DataFrame:
    marked = live.withColumn("is_live", F.lit(True))
    return stations.where("lat is not null and lng is not null").join(quality, "station_id", "left").join(marked, "station_id", "left").withColumn("is_live", F.coalesce("is_live", F.lit(False)))


def latest_day(*tables: DataFrame) -> DataFrame:
    both = tables[0].select("day")
    for t in tables[1:]:
        both = both.unionByName(t.select("day"))
    return both.agg(F.max("day").alias("day"))


def latest_days(rows: DataFrame, n: int = 7) -> DataFrame:
    return rows.select("day").distinct().orderBy(F.desc("day")).limit(n)


def history(store: DataFrame, window: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Store rows, and window rows after each station's last store day; values that are not positive become null; with class."""
    cut = store.groupBy("station_id").agg(F.max("day").alias("_cut"))
    newer = window.join(cut, "station_id", "left").where(F.col("_cut").isNull() | (F.col("day") > F.col("_cut"))).drop("_cut")
    both = store.unionByName(newer).where(F.col("day").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    value = F.when(F.col("pm10") > 0, F.col("pm10"))
    return both.withColumn("pm10", value).withColumn("alert_class", C.label_of(C.alert_class("pm10")))


def latest_metadata(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.groupBy("station_id").agg(F.max_by(F.struct(*columns), "day").alias("m")).select("station_id", "m.*")


def last_rows(rows: DataFrame, n: int = 8) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("station_id").orderBy(F.desc("day")))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def ordered_values(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a station with an array of each column, oldest first, nulls kept."""
    packed = rows.groupBy("station_id").agg(F.sort_array(F.collect_list(F.struct("day", *columns))).alias("r"))
    return packed.select("station_id", *(F.col("r")[c].alias(c) for c in columns))


def _valid(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def pm10_context(values: Column, most_filled: int = 2) -> dict[str, Column]:
    """lag1, lag2, roll7, roll3, diff of an ordered array; gaps of the last known value are filled for two days at most."""
    n = F.size(values)
    at = F.sequence(F.lit(0), n - 1)
    filled = F.transform(at, lambda i: F.coalesce(*(F.when(i >= k, F.get(values, i - k)) for k in range(most_filled + 1))))
    known = _valid(filled)
    tail = lambda k: _valid(F.slice(filled, F.greatest(n - k + 1, F.lit(1)), k))
    lag = lambda k: F.when(F.size(known) >= k, F.get(known, F.size(known) - k))
    seven, three = tail(7), tail(3)
    return {
        "pm10_lag1": lag(1), "pm10_lag2": lag(2), "pm10_roll7": F.when(F.size(seven) >= 3, _mean(seven)),
        "pm10_roll3": F.when(F.size(three) >= 2, _mean(three)), "pm10_diff": lag(1) - lag(2),
    }


def positional(values: Column) -> dict[str, Column]:
    """lag1, lag2 by place, and roll3 of three known values."""
    n = F.size(values)
    three = _valid(F.slice(values, F.greatest(n - 2, F.lit(1)), 3))
    return {"lag1": F.when(n >= 1, F.get(values, n - 1)), "lag2": F.when(n >= 2, F.get(values, n - 2)), "roll3": F.when(F.size(three) == 3, _mean(three))}


#: The columns of a feature row and of the drivers shown.
STATIC = ("province", "altitude", "lat", "lng", "dist_industrial_km")
AHEAD = ("temp_mean", "humidity_mean", "dewpoint_mean", "precip_sum", "pressure_mean", "cloud_cover_mean", "wind_speed_mean", "wind_speed_max", "radiation_mean", "blh_mean", "blh_min", "fog_hours")
POLLUTANTS = ("no2_mean", "o3_mean", "no2_max", "o3_max")
LAGGED = ("pressure_mean", "wind_speed_mean", "blh_mean", "temp_mean")
DRIVERS = (
    "temp_mean", "pm10_lag1", "pm10_lag2", "pm10_roll3", "pm10_roll7", "pm10_diff", "pressure_mean", "pressure_mean_lag1", "wind_speed_mean", "wind_speed_max", "wind_speed_roll3",
    "blh_mean", "blh_min", "precip_sum", "stagnation_index", "no2_mean", "o3_mean", "heating_season", "dist_industrial_km",
)


def _row(columns: Sequence[str], known: Sequence[str]) -> Column:
    """day and numbers as one struct; columns that a table lacks are null."""
    number = lambda c: (F.col(c) if c in known else F.lit(None)).cast("double")
    return F.struct("day", *(number(c).alias(c) for c in columns))


def _packed(rows: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    return rows.groupBy("station_id").agg(F.sort_array(F.collect_list(_row(columns, rows.columns))).alias(name))


def _features(history: Column, ahead: Column) -> dict[str, Column]:
    """Features of the day of ahead (weather struct), from the rows before it (ordered array of structs)."""
    of = lambda c: F.transform(history, lambda r: r[c])
    out = {c: ahead[c] for c in AHEAD} | {c: positional(of(c))["lag1"] for c in POLLUTANTS} | C.calendar(ahead["day"]) | pm10_context(of("pm10"))
    for c in LAGGED:
        p = positional(of(c))
        out |= {f"{c}_lag1": p["lag1"], f"{c}_lag2": p["lag2"]}
    out |= {"pressure_roll3": positional(of("pressure_mean"))["roll3"], "wind_speed_roll3": positional(of("wind_speed_mean"))["roll3"]}
    return out | {"stagnation_flag": C.stagnation_flag(ahead["pressure_mean"], ahead["wind_speed_mean"], ahead["blh_min"]), "stagnation_index": C.stagnation_index(ahead["wind_speed_mean"], ahead["blh_min"], ahead["precip_sum"])}


def planned(recent: DataFrame, weather: DataFrame, quality: DataFrame, metadata: DataFrame, days: int = 2) -> DataFrame:
    """One row a station: its static columns, its last eight rows and the weather ahead as arrays, and why it is refused, if it is.

    Reasons: no metadata (unknown), a stale quality or no recent rows (stale), fewer days of weather than asked (no_weather).
    """
    history = _packed(last_rows(recent), ("pm10", *AHEAD, *POLLUTANTS), "history")
    ahead = _packed(weather, AHEAD, "ahead").withColumn("ahead", F.slice("ahead", 1, days))
    static = [F.col(c) if c in metadata.columns else F.lit(None).cast("string" if c == "province" else "double").alias(c) for c in STATIC]
    known = metadata.select("station_id", *static, F.lit(True).alias("_known"))
    rows = quality.select("station_id", "quality", "valid_days").join(known, "station_id", "left").join(history, "station_id", "left").join(ahead, "station_id", "left")
    few = F.coalesce(F.size("ahead"), F.lit(0)) < days
    reason = F.when(F.col("_known").isNull(), "unknown").when((F.col("quality") == "stale") | F.col("history").isNull(), "stale").when(few, "no_weather")
    # Whether the day before the first one ahead has a value, which only a provisional feed can supply.
    live = F.exists("history", lambda r: (r["day"] == F.date_sub(F.get("ahead", F.lit(0))["day"], 1)) & r["pm10"].isNotNull())
    return rows.withColumns({"reason": reason, "live": F.coalesce(live, F.lit(False))}).drop("_known")


def future_features(recent: DataFrame, weather: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Feature rows of single days ahead, a row a station and day: weather, last pollutants, calendar, lags, stagnation and the static columns."""
    history = _packed(last_rows(recent), ("pm10", *AHEAD, *POLLUTANTS), "history")
    rows = history.join(weather.select("station_id", _row(AHEAD, weather.columns).alias("ahead")), "station_id")
    rows = rows.select("station_id", F.col("ahead")["day"].alias("day"), *(v.alias(k) for k, v in _features(F.col("history"), F.col("ahead")).items()))
    return rows if metadata is None else rows.join(metadata.select("station_id", *(c for c in STATIC if c in metadata.columns)), "station_id", "left")


class Forecast(NamedTuple):
    """Forecasts, and the stations refused with the reason."""

    forecasts: DataFrame
    refused: DataFrame


def forecast(recent: DataFrame, weather: DataFrame, quality: DataFrame, metadata: DataFrame, score: Callable[[DataFrame], DataFrame], days: int = 2, delta: float = 5.0, least: float = 0.35) -> Forecast:
    """Forecasts of `days` days for every station; score adds `predicted` and `proba` to feature rows.

    The plan of all stations is one written table, of which both results are filters. Each further day has the day before as its last
    row: that day's weather, the prediction as it is (rounding is for the output alone), and the last row's pollutants. Stations stay
    one row all along, so the loop over days adds no join and no shuffle, only a small written table a day.
    """
    plan = written(planned(recent, weather, quality, metadata, days), "plan")
    kept = ["station_id", "quality", "valid_days", "live", *STATIC, "history", "ahead", "made"]
    nothing = "array<struct<day:date,horizon:int,predicted:double,class_final:int,source:string,weather_used:struct<temp_mean:double,wind_speed_mean:double,blh_mean:double>,drivers:struct<{}>>>"
    kinds = [f"{c}:double" for c in DRIVERS] + ["stagnation_flag:boolean", "season:string", "province:string"]
    state = plan.where("reason is null").drop("reason").withColumn("made", F.array().cast(nothing.format(",".join(kinds))))
    has = [c for c in AHEAD if c in weather.columns]
    for step in range(days):
        ahead, last = F.get("ahead", F.lit(step)), F.element_at("history", -1)
        scored = score(state.select(*kept, ahead["day"].alias("day"), *(v.alias(k) for k, v in _features(F.col("history"), ahead).items())))
        decision = C.hybrid_decision("predicted", "proba", delta, least)
        used = F.struct(*(ahead[c].alias(c) for c in ("temp_mean", "wind_speed_mean", "blh_mean")))
        made = F.struct(
            F.col("day"), F.lit(step + 1).alias("horizon"), F.round("predicted", 2).alias("predicted"), decision["class_final"].cast("int").alias("class_final"), decision["source"].alias("source"), used.alias("weather_used"), drivers().alias("drivers"),
        )
        row = F.struct(F.col("day"), F.col("predicted").alias("pm10"), *((ahead if c in has else last)[c].alias(c) for c in AHEAD), *(last[c].alias(c) for c in POLLUTANTS))
        state = scored.withColumns({"made": F.concat("made", F.array(made)), "history": F.concat("history", F.array(row))}).select(*kept)
        # A row a station: written, so that the next day's features name the prediction instead of repeating its expression.
        state = written(state, "state") if step < days - 1 else state
    return Forecast(state.select("station_id", "quality", "valid_days", "live", F.inline("made")), plan.where("reason is not null").select("station_id", "reason", "quality", "valid_days"))


def drivers() -> Column:
    """The model's inputs that are shown, as one struct: numbers with NaN as null, the flag as boolean, season and province."""
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c)
    return F.struct(*map(number, DRIVERS), F.col("stagnation_flag").cast("boolean").alias("stagnation_flag"), F.col("season").alias("season"), F.col("province").alias("province"))


def map_rows(stations: DataFrame, forecasts: DataFrame, colours: Sequence[str] = ("green", "yellow", "orange", "red")) -> DataFrame:
    """Stations with fill by forecast class and border by quality."""
    fill = F.coalesce(F.get(F.array(*map(F.lit, colours)), F.col("class_final")), F.lit("grey"))
    border = F.when(F.col("quality") == "ok", "solid").when(F.col("quality") == "partial", "dashed").otherwise("dotted")
    return stations.join(forecasts.where("horizon = 1"), "station_id", "left").select("station_id", fill.alias("fill"), border.alias("border"))
