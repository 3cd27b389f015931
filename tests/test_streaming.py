"""Streams equal their batch twins, and late revisions win."""

import datetime

import pytest
from pyspark.errors import StreamingQueryException

from aerolith.sources import days
from aerolith.streaming import jobs

SCHEMA = jobs.READING


def at(d, h=0):
    return datetime.datetime(2025, 1, d, h)


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_priority_upsert_and_rewrites(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    write(spark, [(1, 10, at(1), 5.0, "NRT"), (1, 10, at(2), 6.0, "NRT")], source)
    jobs.upsert_by_priority(jobs.readings(spark, source), out, f"file://{tmp_path}/state").awaitTermination()
    write(spark, [(1, 10, at(1), 7.0, "VA")], source)
    jobs.upsert_by_priority(jobs.readings(spark, source), out, f"file://{tmp_path}/state").awaitTermination()
    write(spark, [(1, 10, at(1), 9.0, "NRT")], source)
    jobs.upsert_by_priority(jobs.readings(spark, source), out, f"file://{tmp_path}/state").awaitTermination()
    assert sorted(r.value for r in days.read(spark, out).collect()) == [6.0, 7.0]


def test_rewritten_days(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for value in (1.0, 2.0):
        write(spark, [(1, 10, at(1), value, "VA"), (1, 10, at(2 + int(value)), value, "VA")], source)
        jobs.rewrite_days(jobs.readings(spark, source), out, f"file://{tmp_path}/state").awaitTermination()
    assert sorted(r.value for r in days.read(spark, out).collect()) == [1.0, 2.0, 2.0]


def test_staleness(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    write(spark, [(1, 10, at(1), 5.0, "VA"), (2, 20, at(1), -1.0, "VA"), (1, 10, at(2), 6.0, "VA")], source)
    query = jobs.staleness(jobs.readings(spark, source)).writeStream.format("memory").queryName("stale").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.station_id: r.n for r in spark.table("stale").collect() if not r.stale} == {1: 2, 2: 0}


def test_episodes(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    write(spark, [(1, 10, at(d), v, "VA") for d, v in ((1, 60.0), (2, 70.0), (3, 20.0), (9, 55.0))], source)
    query = jobs.exceedances(jobs.readings(spark, source)).writeStream.format("memory").queryName("episodes").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.n, r.value_max) for r in spark.table("episodes").collect()) == [(1, 55.0), (2, 70.0)]


def run(df, tmp_path, name, mode):
    """Lets a stream read what there is, and returns the rows told by this run alone."""
    out = []
    query = df.writeStream.foreachBatch(lambda b, n: out.extend(b.collect())).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def test_dedup_over_batches_restarts_and_late_rows(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    told = lambda: sorted((r.sensor_id, r.ts.day) for r in run(jobs.deduplicated(jobs.readings(spark, source, files_a_batch=1)), tmp_path, "dedup", "append"))
    write(spark, [(1, 10, at(1), 5.0, "VA"), (1, 10, at(1), 6.0, "VA")], source)
    write(spark, [(1, 10, at(1), 5.0, "VA"), (2, 20, at(1), 7.0, "VA")], source)
    assert told() == [(10, 1), (20, 1)]
    write(spark, [(1, 10, at(1), 5.0, "VA"), (1, 10, at(2), 5.0, "VA"), (1, 10, at(10), 5.0, "VA")], source)
    assert told() == [(10, 2), (10, 10)]  # seen before the restart; the new ones pass
    write(spark, [(2, 20, at(3), 1.0, "VA"), (2, 20, at(8), 1.0, "VA")], source)
    assert told() == [(20, 8)]  # day 3 is later than the watermark, day 7, allows


def test_staleness_over_batches_with_timeout_restart_and_late_rows(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    told = lambda: sorted((r.station_id, r.last_valid.day, r.n, r.stale) for r in run(jobs.staleness(jobs.readings(spark, source, files_a_batch=1)), tmp_path, "stale", "update"))
    write(spark, [(1, 10, at(1), 5.0, "VA"), (2, 20, at(1), 5.0, "VA")], source)
    assert told() == [(1, 1, 1, False), (2, 1, 1, False)]
    write(spark, [(1, 10, at(10), 5.0, "VA")], source)
    assert told() == [(1, 10, 2, False), (2, 1, 1, True)]  # the state outlives the restart; station 2 fell silent
    write(spark, [(2, 20, at(2), 5.0, "VA"), (1, 10, at(9), -1.0, "VA")], source)
    assert told() == [(1, 10, 2, False)]  # the reading of day 2 is too late, an invalid value is none
    write(spark, [(2, 20, at(11), 5.0, "VA")], source)
    assert (2, 11, 1, False) in told()


class Killed(Exception):
    pass


def test_readers_never_see_half_a_batch_and_replays_change_nothing(spark, tmp_path, monkeypatch):
    source, out, state = f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    table = lambda: sorted((r.sensor_id, r.ts.day, r.value) for r in days.read(spark, out).collect())
    go = lambda: jobs.rewrite_days(jobs.readings(spark, source), out, state).awaitTermination()
    write(spark, [(1, 10, at(1), 1.0, "VA"), (1, 10, at(2), 1.0, "VA")], source)
    go()
    write(spark, [(1, 10, at(1), 2.0, "VA"), (1, 10, at(3), 2.0, "VA")], source)

    def killed(*_):
        raise Killed

    with monkeypatch.context() as m, pytest.raises(StreamingQueryException):
        m.setattr(days, "_publish", killed)  # the rows of all days are written, the commit is not
        go()
    assert table() == [(10, 1, 1.0), (10, 2, 1.0)]
    go()
    after = [(10, 1, 2.0), (10, 2, 1.0), (10, 3, 2.0)]
    assert table() == after
    numbers = days.commits(spark, out)
    for f in ("1", ".1.crc"):
        (tmp_path / "state" / "state" / "commits" / f).unlink(missing_ok=True)  # as if the stream died before it noted its second batch
    go()
    assert table() == after and days.commits(spark, out) == numbers
