"""The log of commits of tables by day."""

import datetime

import pytest
from pyspark.sql import functions as F

from aerolith.sources import days, files


def rows(spark, value, *numbers):
    return spark.createDataFrame([(s, datetime.date(2025, 1, n) if n else None, float(value)) for s in range(2) for n in numbers], "station_id long, day date, value double")


def seen(df):
    return sorted((r.day.day if r.day else 0, r.value) for r in df.collect())


def test_days_are_replaced_whole_and_older_commits_stay_readable(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    first = days.overwrite(rows(spark, 1, 1, 2, 0), path)
    days.overwrite(rows(spark, 2, 2, 3), path, days=["2025-01-01"])
    assert seen(days.read(spark, path)) == [(0, 1.0)] * 2 + [(2, 2.0)] * 2 + [(3, 2.0)] * 2
    assert seen(days.read(spark, path, commit=first)) == [(0, 1.0)] * 2 + [(1, 1.0)] * 2 + [(2, 1.0)] * 2
    assert seen(days.read(spark, path, ["2025-01-03", "2024-01-01"])) == [(3, 2.0)] * 2
    assert days.read(spark, path, []).count() == 0 and days.read(spark, path).columns == ["station_id", "day", "value"]
    with pytest.raises(ValueError):
        days.read(spark, f"{path}-none")


def test_folders_of_other_days_are_not_opened(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    days.overwrite(rows(spark, 1, 1, 2), path)
    for f in tmp_path.glob("t/data/*/day=2025-01-02/*.parquet"):
        f.write_bytes(b"broken")
    assert seen(days.read(spark, path, ["2025-01-01"])) == [(1, 1.0)] * 2


def test_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    base = days.overwrite(rows(spark, 1, 1, 2), path)
    days.overwrite(rows(spark, 2, 2), path, base=base)
    days.overwrite(rows(spark, 3, 1), path, base=base)  # another day: both stand
    with pytest.raises(days.DayChanged):
        days.overwrite(rows(spark, 4, 2), path, base=base)
    assert seen(days.read(spark, path)) == [(1, 3.0)] * 2 + [(2, 2.0)] * 2
    assert not days._publish(spark, path, {"number": 1}) and days.commits(spark, path) == [0, 1, 2]


def test_tidy_keeps_what_the_last_commits_name(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for v in range(4):
        days.overwrite(rows(spark, v, 1, *([2] if v == 0 else [])), path)
    assert len(days.tidy(spark, path, keep=1)) == 2  # the first run still holds day 2
    assert seen(days.read(spark, path)) == [(1, 3.0)] * 2 + [(2, 0.0)] * 2
    days.overwrite(rows(spark, 9, 1), path)
    assert days.commits(spark, path) == [3, 4]


def test_target_window_falls_back_to_the_calendar(spark):
    names = spark.createDataFrame([("feed/2025-01-0%d_m.json" % d,) for d in (1, 3, 3, 7)] + [("notes.txt",)], "name string")
    today = F.lit("2025-02-10").cast("date")
    get = lambda df: sorted(str(r.day) for r in df.collect())
    assert get(files.target_window(names, 2, today=today)) == ["2025-01-03", "2025-01-07"] == get(files.target_window(names, 2))
    none = names.where("name = 'notes.txt'")
    assert get(files.target_window(none, 3, today=today, behind=2)) == ["2025-02-06", "2025-02-07", "2025-02-08"]
    assert get(files.target_window(none, 3)) == []
