"""Temporal splits and folds, as columns, and the guards that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def days_of(rows: DataFrame) -> list:
    """All days in order: a value a day, which is few however many rows there are."""
    return sorted(r[0] for r in rows.select("day").distinct().collect())


def temporal_split(rows: DataFrame, train_ratio: float = 0.7) -> DataFrame:
    """rows with column split: the earliest days, whole, are train. A ValueError if a side would be empty."""
    days = days_of(rows)
    n_train = int(len(days) * train_ratio)
    if not 0 < n_train < len(days):
        raise ValueError("a side of the split is empty")
    return rows.withColumn("split", F.when(F.col("day") <= F.lit(days[n_train - 1]), "train").otherwise("test"))


def temporal_folds(rows: DataFrame, k: int = 5) -> DataFrame:
    """rows with column val_fold: the fold that validates a row, 0 for the first block; fold f trains on smaller ones."""
    days = days_of(rows)
    if len(days) < k + 1:
        raise ValueError(f"{k} folds need {k + 1} days")
    size = len(days) // (k + 1)
    begins = [days[len(days) - f * size] for f in range(k, 0, -1)]
    return rows.withColumn("val_fold", sum(((F.col("day") >= F.lit(d)).cast("int") for d in begins), F.lit(0)))


def fold_classes(folds: DataFrame, classes: int = 4, k: int = 5) -> DataFrame:
    """fold, missing_train, missing_val: class ids that a fold's sides lack. Needs val_fold and class_id."""
    seen = folds.select("val_fold", "class_id").distinct()
    numbers = folds.sparkSession.range(1, k + 1).withColumnRenamed("id", "fold")
    pairs = seen.join(F.broadcast(numbers), F.col("val_fold") <= F.col("fold"))
    every = F.sequence(F.lit(0), F.lit(classes - 1))
    lacks = lambda c: F.concat_ws(",", F.array_except(every, F.collect_set(F.when(c, F.col("class_id")))))
    return pairs.groupBy("fold").agg(lacks(F.col("val_fold") < F.col("fold")).alias("missing_train"), lacks(F.col("val_fold") == F.col("fold")).alias("missing_val"))


def split_summary(rows: DataFrame) -> DataFrame:
    """Range, rows and stations of each side."""
    return rows.groupBy("split").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("station_id").alias("n_stations"))


def signature(rows: DataFrame, column: str) -> DataFrame:
    """An order-free signature of how keys are assigned: rows, xor and sum of key hashes."""
    h = F.xxhash64("station_id", "day", column)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("xor_hash"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("sum_hash"))


def assert_holdout(rows: DataFrame) -> None:
    """A ValueError unless both sides have rows and all train days come before all test days."""
    last, first = rows.agg(F.max(F.when(F.col("split") == "train", F.col("day"))), F.min(F.when(F.col("split") == "test", F.col("day")))).first()
    if last is None or first is None:
        raise ValueError("a side of the split is empty")
    if last >= first:
        raise ValueError(f"train days reach {last}, test days begin at {first}")


def station_differences(rows: DataFrame) -> DataFrame:
    """Stations that only one side has."""
    sides = rows.groupBy("station_id").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"))
    return sides.where("n_train = 0 or n_test = 0")


def assert_stations(rows: DataFrame) -> None:
    if (found := station_differences(rows).first()) is not None:
        raise ValueError(f"station {found['station_id']} is on one side only")


def fold_summary(folds: DataFrame) -> DataFrame:
    """Rows, first and last day of each validation block."""
    return folds.groupBy("val_fold").agg(F.count(F.lit(1)).alias("n_rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def assert_folds(folds: DataFrame, k: int = 5) -> None:
    """A ValueError unless there are k non-empty folds whose days follow one another."""
    rows = sorted(fold_summary(folds).collect(), key=lambda r: r["val_fold"])  # k + 1 rows
    if [r["val_fold"] for r in rows] != list(range(k + 1)):
        raise ValueError(f"expected {k} folds and a first block")
    if any(a["last_day"] >= b["first_day"] for a, b in zip(rows, rows[1:])):
        raise ValueError("folds overlap in time")


def assert_manifests(manifests: DataFrame, columns: tuple[str, ...] = ("split_signature", "fold_signature", "seed", "k")) -> None:
    """A ValueError if models were made on other splits, folds or seeds."""
    row = manifests.agg(*(F.countDistinct(c).alias(c) for c in columns)).first()
    if differing := [c for c in columns if row[c] != 1]:
        raise ValueError(f"models differ in {', '.join(differing)}")


def valid_targets(rows: DataFrame) -> DataFrame:
    """Rows with a target and a known class label, as class_id."""
    from aerolith.functions.columns import class_id_of

    return rows.withColumn("class_id", class_id_of("alert_class")).where("pm10 is not null and class_id is not null")


def attach_targets(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """Scored rows with their true targets by (station, day); a ValueError if a row has none."""
    keys = ["station_id", "day"]
    if (lost := scored.join(truth, keys, "left_anti").first()) is not None:
        raise ValueError(f"no target for station {lost['station_id']} on {lost['day']}")
    return scored.join(truth, keys)
