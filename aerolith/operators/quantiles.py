"""Exact interpolated quantiles by distributed selection, of many columns and groups at a time.

A quantile of n values lies between the values of two neighbouring ranks. Brackets around these ranks are narrowed until each holds
few values: an approximate percentile, whose error is bounded, gives ends that the ranks can't be outside of, and a count gives the ranks
before them. Each round leaves about one value in 500; only then are the values of a bracket sorted. So no aggregate
buffer and no task holds more than `limit` different values of a group, whatever the table. The columns are written once. Up to `limit` values take two passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.sources.scratch import discard, fresh_path, written

#: Values of a bracket that are sorted, and the accuracy of approximate percentiles (their ranks are off by n / ACCURACY at most).
LIMIT, ACCURACY = 1 << 16, 2000


def quantiles(rows: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), limit: int = LIMIT) -> DataFrame:
    """A row a group of by (one row without by): for each column an array of its quantiles; null where it has no value. NaN counts as null."""
    targets = [(c, p) for c in columns for p in probs]
    keys = [f"_g{i}" for i in range(len(by))] or ["_g0"]
    groups = [F.col(c) for c in by] or [F.lit(0)]
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    data = rows.select(*(g.alias(k) for g, k in zip(groups, keys)), *(value(c).alias(f"v{i}") for i, c in enumerate(columns)))
    # All passes have to see the same values, and sums of doubles may differ in their last digit each time they are computed.
    spark, path = rows.sparkSession, fresh_path(rows.sparkSession, "values")
    data.write.parquet(path)
    data = spark.read.schema(data.schema).parquet(path)
    place = {c: f"v{i}" for i, c in enumerate(columns)}
    cells = range(len(targets))
    x = [F.col(place[c]) for c, _ in targets]
    field = lambda t, name: F.col(f"s{t}")[name]

    def joined(state: DataFrame) -> DataFrame:
        names = state.select(*(F.col(k).alias(f"_{k}") for k in keys), *(f"s{t}" for t in cells))
        same = F.lit(True)
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        return data.join(names, same).drop(*(f"_{k}" for k in keys))

    first = [F.struct(F.min(x[t]).alias("lo"), F.max(x[t]).alias("hi"), F.lit(0).cast("long").alias("below"), F.count(x[t]).alias("inside"), F.count(x[t]).alias("between"), F.count(x[t]).alias("n")).alias(f"s{t}") for t in cells]
    state = written(data.groupBy(*keys).agg(*first), "quantiles")
    # Copies of an end of a bracket are one value, so only what lies between the ends counts against the limit.
    open_ = lambda t: (field(t, "between") > limit) & (field(t, "lo") < field(t, "hi"))
    some = F.lit(False)
    for t in cells:
        some |= open_(t)
    while not state.where(some).isEmpty():
        wide = joined(state)
        inside = [(x[t] >= field(t, "lo")) & (x[t] <= field(t, "hi")) for t in cells]
        # The approximate percentiles of a fixed set of shares, of which the ones around the rank are taken.
        grid = F.array(*(F.lit(i / (ACCURACY // 4)) for i in range(ACCURACY // 4 + 1)))
        edges = [F.when(F.first(open_(t)), F.percentile_approx(F.when(inside[t] & open_(t), x[t]), grid, ACCURACY)).alias(f"e{t}") for t in cells]
        marks = written(wide.groupBy(*keys).agg(*edges, *(F.first(f"s{t}").alias(f"s{t}") for t in cells)), "edges")

        def end(t: int, up: bool):
            # Shares lie 4 / ACCURACY apart and are off by 1 / ACCURACY: one step aside holds the rank for sure.
            share = ((field(t, "n") - 1) * targets[t][1] - field(t, "below")) / field(t, "inside") * (ACCURACY // 4)
            at = F.least(F.ceil(share) + 1, F.lit(ACCURACY // 4)) if up else F.greatest(F.floor(share) - 1, F.lit(0))
            found = F.get(f"e{t}", at.cast("int"))
            return F.when(open_(t), F.least(found, field(t, "hi")) if up else F.greatest(found, field(t, "lo"))).otherwise(field(t, "hi" if up else "lo"))

        narrowed = marks.select(*keys, *(F.struct(end(t, False).alias("lo"), end(t, True).alias("hi"), field(t, "n").alias("n")).alias(f"s{t}") for t in cells))
        narrowed = written(narrowed, "narrowed")
        again = joined(narrowed)
        counts = [
            F.struct(F.first(field(t, "lo")).alias("lo"), F.first(field(t, "hi")).alias("hi"), F.count_if(x[t] < field(t, "lo")).alias("below"), F.count_if((x[t] >= field(t, "lo")) & (x[t] <= field(t, "hi"))).alias("inside"), F.count_if((x[t] > field(t, "lo")) & (x[t] < field(t, "hi"))).alias("between"), F.first(field(t, "n")).alias("n")).alias(f"s{t}")
            for t in cells
        ]
        state = written(again.groupBy(*keys).agg(*counts), "quantiles")
    wide = joined(state)
    # A bracket of one value needs no rows: all its ranks have that value.
    held = F.filter(F.array(*(F.struct(F.lit(t).alias("t"), x[t].alias("x"), (field(t, "below")).alias("below"), field(t, "n").alias("n")) for t in cells)), lambda z: z["x"].isNotNull())
    keep = F.filter(held, lambda z: F.get(F.array(*((x[t] >= field(t, "lo")) & (x[t] <= field(t, "hi")) & (field(t, "lo") < field(t, "hi")) for t in cells)), z["t"]))
    long = wide.select(*keys, F.inline(keep)).groupBy(*keys, "t", "x").agg(F.count(F.lit(1)).alias("m"), F.first("below").alias("below"), F.first("n").alias("n"))
    w = Window.partitionBy(*keys, "t").orderBy("x")
    share = F.get(F.array(*(F.lit(float(p)) for _, p in targets)), F.col("t"))
    ranked = long.withColumns({"end": F.col("below") + F.sum("m").over(w), "position": (F.col("n") - 1) * share})
    at = lambda rank: F.max(F.when((rank >= F.col("end") - F.col("m")) & (rank < F.col("end")), F.col("x")))
    low, high = F.floor("position"), F.ceil("position")
    parts = ranked.groupBy(*keys, "t").agg(at(low).alias("a"), at(high).alias("b"), F.first("position").alias("position"))
    mixed = F.when(low == high, F.col("a")).otherwise((high - F.col("position")) * F.col("a") + (F.col("position") - low) * F.col("b"))
    found = parts.select(*keys, "t", mixed.alias("q")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("t", "q"))).alias("found"))
    found = found.select(*(F.col(k).alias(f"_{k}") for k in keys), "found")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = state.join(found, same, "left")
    one = lambda t: F.when(field(t, "lo") == field(t, "hi"), field(t, "lo")).otherwise(F.try_element_at("found", F.lit(t)))
    arrays = [F.when(field(i * len(probs), "n") > 0, F.array(*(one(i * len(probs) + j) for j in range(len(probs))))).alias(c) for i, c in enumerate(columns)]
    out = written(both.select(*(F.col(k).alias(c) for k, c in zip(keys, by)), *arrays), "quantiles")
    discard(spark, path)
    return out


def overall(rows: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float] | None]:
    """Quantiles of whole columns: a list a column, None for a column without values."""
    row = quantiles(rows, columns, probs).first() if columns else None
    return {c: None if row is None else row[c] for c in columns}
