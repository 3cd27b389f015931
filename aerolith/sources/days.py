"""Tables by day that a reader sees whole: rows in folders that never change, and a log of commits that point at them.

    <path>/data/run=<name>/day=<day>/   rows
    <path>/commits/<number>.json        the folder of each day, the columns, and the last batch taken from each stream

A writer writes its rows to a folder of its own, then one commit. The commit file appears under its number by a rename that fails if
that number is taken, so readers see the days before or after it and never a mixture, and a writer killed before it has changed
nothing. A batch of a stream that a commit already holds is not taken again. The shared file system must rename in one step, as HDFS does.
A log holds a line a day, which is what reaches the driver.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Collection, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from aerolith.sources.scratch import discard

#: Commits start from here: nothing written yet.
EMPTY = {"number": -1, "days": {}, "schema": None, "batches": {}}
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


class DayChanged(RuntimeError):
    """A day was rewritten by another commit since it was read."""


def _folder(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    folder, fs = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def commits(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the commits in the log, ascending."""
    return sorted(int(n[:-5]) for n in _names(spark, f"{path}/commits") if re.fullmatch(r"\d{12}\.json", n))


def _file(path: str, number: int) -> str:
    return f"{path}/commits/{number:012d}.json"


def commit_of(spark: SparkSession, path: str, number: int | None = None) -> dict:
    """A commit, by default the newest; EMPTY where there is none."""
    if number is None:
        numbers = commits(spark, path)
        if not numbers:
            return EMPTY
        number = numbers[-1]
    file, fs = _folder(spark, _file(path, number))
    stream = fs.open(file)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, commit: dict) -> bool:
    """Makes the commit visible; False if its number is taken."""
    hidden, fs = _folder(spark, f"{path}/commits/.{uuid.uuid4().hex}")
    target, _ = _folder(spark, _file(path, commit["number"]))
    out = fs.create(hidden, True)
    out.write(bytearray(json.dumps(commit), "utf-8"))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(hidden, target, spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Py4JJavaError as e:
        fs.delete(hidden, False)
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def overwrite(rows: DataFrame, path: str, days: Collection[str] | None = None, base: dict | None = None, source: str | None = None, batch: int | None = None) -> dict:
    """Replaces the days that rows (with day) have, and `days`, which go if rows have none of them. Returns the commit.

    base is the commit that rows were made from: DayChanged if another has rewritten one of these days since. source and batch mark a
    batch of a stream; one that the log holds changes nothing.
    """
    spark = rows.sparkSession
    if source is not None and taken(spark, path, source, batch):
        return commit_of(spark, path)
    run = f"{re.sub(r'[^0-9A-Za-z-]', '-', source)}-{batch}" if source is not None else uuid.uuid4().hex
    target = f"{path}/data/run=r-{run}"
    spread = F.pmod(F.hash(*[c for c in rows.columns if c != "day"][:1]), F.lit(8))
    rows.repartition("day", spread).write.mode("overwrite").partitionBy("day").parquet(target)
    written = [n.partition("=")[2] for n in _names(spark, target) if n.startswith("day=")]
    touched = {*written, *(days or ())}
    while True:
        last = commit_of(spark, path)
        if base is not None and (changed := sorted(d for d in touched if last["days"].get(d) != base["days"].get(d))):
            discard(spark, target)
            raise DayChanged(", ".join(changed))
        folders = {d: f for d, f in last["days"].items() if d not in touched} | dict.fromkeys(written, f"run=r-{run}")
        batches = last["batches"] | ({source: batch} if source is not None else {})
        commit = {"number": last["number"] + 1, "days": folders, "schema": rows.schema.json(), "batches": batches}
        if _publish(spark, path, commit):
            return commit


def taken(spark: SparkSession, path: str, source: str, batch: int) -> bool:
    """Whether the log holds this batch of this stream, or a later one."""
    return commit_of(spark, path)["batches"].get(source, -1) >= batch


def read(spark: SparkSession, path: str, days: Collection[str] | None = None, commit: dict | None = None) -> DataFrame:
    """The rows of a commit, by default the newest, all or some days; folders of other days are not opened. A ValueError where nothing was ever written."""
    commit = commit or commit_of(spark, path)
    if commit["schema"] is None:
        raise ValueError(f"no commit in {path}")
    schema = StructType.fromJson(json.loads(commit["schema"]))
    folders = [f"{path}/data/{f}/day={d}" for d, f in sorted(commit["days"].items()) if days is None or d in days]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(StructType(schema.fields).add("run", StringType())).option("basePath", f"{path}/data").parquet(*folders).select(schema.names)


def days_of(rows: DataFrame) -> list[str]:
    """The days of rows as the log names them: a row a day."""
    return [NO_DAY if r[0] is None else str(r[0]) for r in rows.select("day").distinct().collect()]


def tidy(spark: SparkSession, path: str, keep: int = 10) -> Sequence[str]:
    """Deletes all but the last `keep` commits and the folders that only those named; who reads an older commit must be done."""
    numbers = commits(spark, path)
    old, kept = numbers[:-keep], numbers[-keep:]
    used = {f for n in kept for f in commit_of(spark, path, n)["days"].values()}
    gone = sorted({f for n in old for f in commit_of(spark, path, n)["days"].values()} - used)
    for n in old:
        discard(spark, _file(path, n))
    for f in gone:
        discard(spark, f"{path}/data/{f}")
    return gone
