"""The daily panel: calendar spine, joins, lags and rolling means, cleaning and imputation.

All windows of a station share one specification, so Spark sorts a station once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from aerolith.functions import columns as C
from aerolith.operators.quantiles import overall
from aerolith.sources.scratch import written

LAGGED = ("pressure_mean", "wind_speed_mean", "blh_mean", "temp_mean")
KEYS = ("station_id", "day")
#: Columns that follow from others and are dropped.
REDUNDANT = ("temp_max", "temp_min", "pressure_mean_lag2")
LAG_ENDINGS = ("_lag1", "_lag2", "_roll3", "_roll7", "_diff")
WEATHER = ("temp", "humidity", "dewpoint", "precip", "pressure", "cloud", "wind", "visibility", "radiation", "blh", "fog")
POLLUTANT = ("no2_", "o3_", "co_", "pm25_")


def by_day() -> WindowSpec:
    return Window.partitionBy("station_id").orderBy("day")


def fill_days(rows: DataFrame, constant: Sequence[str] = ()) -> DataFrame:
    """Every day from a station's first to its last; new days are null but for the station's constant columns."""
    spine = rows.groupBy("station_id").agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"), *(F.min_by(c, "day").alias(c) for c in constant))
    days = spine.select("station_id", *constant, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias("day"))
    return days.join(rows.drop(*constant), [*KEYS], "left")


def fill_static(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls take the last earlier value of the station, else the first later one."""
    back = by_day().rowsBetween(Window.unboundedPreceding, 0)
    ahead = by_day().rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead)) for c in columns})


def join_sources(pm10: DataFrame, weather: DataFrame, pollutants: DataFrame, proximity: DataFrame) -> DataFrame:
    return pm10.join(weather, [*KEYS], "left").join(pollutants, [*KEYS], "left").join(proximity, "station_id", "left")


def trailing_mean(c: str, days: int, at_least: int) -> Column:
    """Mean of the days before, without today; null with fewer than at_least values."""
    frame = by_day().rowsBetween(-days, -1)
    return F.when(F.count(c).over(frame) >= at_least, F.avg(c).over(frame))


def with_lags(panel: DataFrame) -> DataFrame:
    """Calendar lags and trailing means of a panel without gaps."""
    new = {f"{c}_lag{k}": F.lag(c, k).over(by_day()) for c in ("pm10", *LAGGED) for k in (1, 2)}
    new |= {"pm10_roll7": trailing_mean("pm10", 7, 1), "pm10_roll3": trailing_mean("pm10", 3, 1)}
    new |= {"pressure_roll3": trailing_mean("pressure_mean", 3, 3), "wind_speed_roll3": trailing_mean("wind_speed_mean", 3, 3)}
    return panel.withColumns(new).withColumn("pm10_diff", F.col("pm10_lag1") - F.col("pm10_lag2"))


def with_calendar(panel: DataFrame) -> DataFrame:
    return panel.withColumns(C.calendar("day"))


def with_stagnation(panel: DataFrame) -> DataFrame:
    return panel.withColumns({
        "stagnation_flag": C.stagnation_flag(F.col("pressure_mean"), F.col("wind_speed_mean"), F.col("blh_min")),
        "stagnation_index": C.stagnation_index(F.col("wind_speed_mean"), F.col("blh_min"), F.col("precip_sum")),
    })


def with_class(panel: DataFrame) -> DataFrame:
    return panel.withColumn("alert_class", C.label_of(C.alert_class("pm10")))


def build(pm10: DataFrame, weather: DataFrame, pollutants: DataFrame, proximity: DataFrame, constant: Sequence[str] = ()) -> DataFrame:
    """The raw panel, redundant columns dropped."""
    filled = fill_days(pm10, constant)
    return with_stagnation(with_class(with_lags(with_calendar(join_sources(filled, weather, pollutants, proximity))))).drop(*REDUNDANT)


def missing_shares(panel: DataFrame) -> DataFrame:
    """column_name, missing: the share of nulls of each column, in one pass."""
    one = panel.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in panel.columns))
    return one.unpivot([], panel.columns, "column_name", "missing")


def drop_sparse_columns(panel: DataFrame, most: float = 0.5, keep: Sequence[str] = ("station_id", "day", "pm10")) -> DataFrame:
    """Without columns of which more than this share is null. The shares are one row a column."""
    sparse = [r[0] for r in missing_shares(panel).where(F.col("missing") > most).collect()]
    return panel.drop(*(c for c in sparse if c not in keep))


def covered_stations(panel: DataFrame, least: float = 0.5) -> DataFrame:
    """Stations whose days with a target are at least this share of all days."""
    n = panel.select("day").distinct().count()
    days = panel.groupBy("station_id").agg(F.countDistinct(F.when(F.col("pm10").isNotNull(), F.col("day"))).alias("n"))
    return days.where((F.col("n") == 0) | (F.col("n") >= least * n)).select("station_id")


def carry_forward(panel: DataFrame) -> DataFrame:
    """Pollutants, lags and trailing means take their last known earlier value."""
    chosen = [c for c in panel.columns if c.startswith(POLLUTANT) or c.endswith(LAG_ENDINGS)]
    return panel.withColumns({c: F.last(c, ignorenulls=True).over(by_day().rowsBetween(Window.unboundedPreceding, 0)) for c in chosen})


def clean(panel: DataFrame) -> DataFrame:
    """Sparse columns and stations dropped, lags and pollutants carried forward, rows without a target dropped.

    The panel is written once; shares, days and the result come from what was written.
    """
    kept = drop_sparse_columns(written(panel, "panel"))
    return carry_forward(kept.join(covered_stations(kept), "station_id", "left_semi")).where("pm10 is not null")


def imputable(columns: Sequence[str]) -> list[str]:
    """Weather, pollutant and lag columns by their names."""
    return [c for c in columns if c.startswith(WEATHER + POLLUTANT) or c.endswith(LAG_ENDINGS)]


def fit_medians(train: DataFrame, columns: Sequence[str] | None = None) -> dict[str, float]:
    """Exact medians of the columns that have nulls in train; a number a column."""
    columns = imputable(train.columns) if columns is None else columns
    row = train.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first() if columns else {}
    found = overall(train, [c for c in columns if row[c]], [0.5])
    return {c: q[0] for c, q in found.items() if q is not None}


def impute(rows: DataFrame, medians: dict[str, float]) -> DataFrame:
    return rows.fillna({c: float(v) for c, v in medians.items() if c in rows.columns})


def clean_and_impute(panel: DataFrame) -> DataFrame:
    """Cleaning and imputation on all rows at once: later rows leak into earlier ones; kept for comparison only."""
    cleaned = written(clean(panel), "cleaned")
    return impute(cleaned, fit_medians(cleaned))
