"""Structured Streaming forms of the rolling refresh. Times are timestamps in a UTC session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from aerolith.operators.ingest import first_wins, upsert
from aerolith.sources import days

READING = "station_id long, sensor_id long, ts timestamp, value double, status string"


def readings(spark: SparkSession, path: str, schema: str = READING, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def deduplicated(stream: DataFrame, delay: str = "3 days") -> DataFrame:
    """One row for each sensor and time within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["sensor_id", "ts"])


def daily(stream: DataFrame, delay: str = "3 days") -> DataFrame:
    """Daily mean, largest and count by station."""
    grouped = stream.withWatermark("ts", delay).where("value > 0").groupBy(F.window("ts", "1 day"), "station_id")
    out = grouped.agg(F.avg("value").alias("value_mean"), F.max("value").alias("value_max"), F.count(F.lit(1)).alias("n"))
    return out.select("station_id", F.to_date("window.start").alias("day"), "value_mean", "value_max", "n")


def sliding(stream: DataFrame, span: str = "7 days", slide: str = "1 day", delay: str = "3 days") -> DataFrame:
    out = stream.withWatermark("ts", delay).where("value > 0").groupBy(F.window("ts", span, slide), "station_id").agg(F.avg("value").alias("value_mean"))
    return out.select("station_id", F.to_date("window.end").alias("until"), "value_mean")


def merged_days(stream: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame, DataFrame | None], DataFrame]) -> StreamingQuery:
    """Merges each batch (with day) into a table by day: merge(batch, the old rows of its days or None) gives the new rows of these days.

    A batch is one commit of sources/days.py, so readers never see half of it; one that is replayed after a failure changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        source = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint  # the id lives as long as the checkpoint
        if days.taken(spark, path, source, number):
            return
        base, touched = days.commit_of(spark, path), days.days_of(batch)
        old = days.read(spark, path, touched, base) if base["schema"] else None
        days.overwrite(merge(batch, old), path, touched, base, source, number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()


def rewrite_days(stream: DataFrame, path: str, checkpoint: str, arrival: str | None = None) -> StreamingQuery:
    """Merges late and revised readings: each batch rewrites only the days it touches; the newest batch wins by (sensor, ts).

    Inside a batch the row of the largest arrival wins; without such a column, that of the largest value.
    """

    def merge(batch: DataFrame, old: DataFrame | None) -> DataFrame:
        fresh = first_wins(batch, ["sensor_id", "ts"], [F.desc(arrival or "value")])
        return fresh if old is None else upsert(old.select(fresh.columns), fresh, ["sensor_id", "ts"])

    return merged_days(stream.withColumn("day", F.to_date("ts")), path, checkpoint, merge)


def upsert_by_priority(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Validated readings replace provisional ones of the same sensor and time, never the other way round."""

    def merge(batch: DataFrame, old: DataFrame | None) -> DataFrame:
        both = batch.withColumn("_run", F.lit(1))
        if old is not None:
            both = both.unionByName(old.withColumn("_run", F.lit(0)))
        return first_wins(both, ["sensor_id", "ts"], [(F.col("status") != "VA").cast("int"), F.desc("_run"), F.desc("value")]).drop("_run")

    return merged_days(stream.withColumn("day", F.to_date("ts")), path, checkpoint, merge)


def staleness(stream: DataFrame, silent: str = "3 days") -> DataFrame:
    """station_id, last_valid, n, stale: updated with each batch; a station that stays silent is reported stale once its timeout passes."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"station_id": [key[0]], "last_valid": [pd.Timestamp(last, unit="us")], "n": [n], "stale": [True]})
            return
        for frame in frames:
            good = frame[frame.value > 0]
            n += len(good)
            if len(good):
                last = max(last, int(good.ts.max().value // 1000))
        state.update((last, n))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + 1 + int(pd.Timedelta(silent).total_seconds() * 1000))
        yield pd.DataFrame({"station_id": [key[0]], "last_valid": [pd.Timestamp(last, unit="us")], "n": [n], "stale": [False]})

    return stream.withWatermark("ts", silent).groupBy("station_id").applyInPandasWithState(update, "station_id long, last_valid timestamp, n long, stale boolean", "last long, n long", "update", GroupStateTimeout.EventTimeTimeout)


def exceedances(stream: DataFrame, limit: float = 50.0, gap: str = "2 days", delay: str = "3 days") -> DataFrame:
    """Episodes of values above the limit, closed by a gap."""
    over = stream.withWatermark("ts", delay).where(F.col("value") > limit)
    out = over.groupBy(F.session_window("ts", gap), "station_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value_max"))
    return out.select("station_id", F.col("session_window.start").alias("begins"), F.col("session_window.end").alias("ends"), "n", "value_max")
