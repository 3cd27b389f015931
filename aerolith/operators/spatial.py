"""Distance of stations to points and polygons on grids whose cells double until each station's nearest is sure."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.sources.scratch import written

#: Fixed values of the WGS84 ellipsoid and of UTM zone 32.
AXIS, FLATTENING, SCALE, MERIDIAN, FALSE_EAST = 6378137.0, 1 / 298.257223563, 0.9996, 9.0, 500000.0


def utm(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing in zone 32 by Krueger's series."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = np.radians(lat), np.radians(lon - MERIDIAN)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return FALSE_EAST + SCALE * radius * x, SCALE * radius * y


def _at(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size).cast("long")


def nearest(waiting: DataFrame, items: DataFrame, cell: float, distance: Column, slack: float = 0.0) -> DataFrame:
    """station_id, distance of the nearest item for (station_id, x, y); items have a place ix, iy and reach at most `slack` from it.

    Grids double their cell from round to round, and a station meets the nine cells around it in each until its best is inside
    them. Occupied quarters of these cells stand for their items first: of a quarter, its distance less the slack is a lower
    bound, the distance of its first item an upper one; only quarters whose lower bound is not above the station's least upper one
    are opened. Each round is written, so none is computed twice.
    """
    spark = waiting.sparkSession
    ends = [f(c) for c in ("x", "y") for f in (F.min, F.max)]
    here, there = waiting.agg(*ends).first(), items.select(F.col("ix").alias("x"), F.col("iy").alias("y")).agg(*ends).first()
    if here[0] is None or there[0] is None:
        return spark.createDataFrame([], "station_id long, distance double")
    extent = max(max(here[i + 1], there[i + 1]) - min(here[i], there[i]) for i in (0, 2)) + slack
    out, size = None, cell
    while True:
        last = size >= extent
        fine = items.withColumns({"fx": _at("ix", size / 4), "fy": _at("iy", size / 4)})
        quarters = fine.groupBy("fx", "fy").agg(F.min(F.struct(*items.columns)).alias("one")).select("fx", "fy", F.floor(F.col("fx") / 4).alias("cx"), F.floor(F.col("fy") / 4).alias("cy"), "one.*")
        around = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1))))
        probes = waiting.withColumn("d", around).select("station_id", "x", "y", (_at("x", size) + F.col("d.dx")).alias("cx"), (_at("y", size) + F.col("d.dy")).alias("cy"))
        apart = lambda c, f: F.greatest(F.col(f) * size / 4 - F.col(c), F.col(c) - (F.col(f) + 1) * size / 4, F.lit(0.0))
        met = probes.join(quarters, ["cx", "cy"]).select("station_id", "x", "y", "fx", "fy", F.hypot(apart("x", "fx"), apart("y", "fy")).alias("low"), distance.alias("high"))
        met = met.withColumn("least", F.min("high").over(Window.partitionBy("station_id"))).where(F.col("low") - slack <= F.col("least"))
        found = met.select("station_id", "x", "y", "fx", "fy").join(fine, ["fx", "fy"]).groupBy("station_id").agg(F.min(distance).alias("distance"))
        sure = written(found if last else found.where(F.col("distance") <= size - slack), "nearest")
        out = sure if out is None else out.unionByName(sure)
        if last:
            return out
        waiting, size = written(waiting.join(sure, "station_id", "left_anti"), "waiting"), 2 * size
        if waiting.isEmpty():
            return out


def nearest_point(stations: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """station_id, distance to the nearest point. Stations or points without coordinates are left out."""
    placed = points.where("x is not null and y is not null").select(F.col("x").cast("double").alias("ix"), F.col("y").cast("double").alias("iy")).distinct()
    waiting = stations.where("x is not null and y is not null").select("station_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return nearest(waiting, placed, cell, F.hypot(F.col("x") - F.col("ix"), F.col("y") - F.col("iy")))


def edges(zones: DataFrame) -> DataFrame:
    """zone_id, ax, ay, bx, by of the edges of rings (arrays of lon, lat), in metres, closed."""

    @F.pandas_udf("array<struct<x: double, y: double>>")
    def project(rings: pd.Series) -> pd.Series:
        out = []
        for ring in rings:
            x, y = utm(np.array([p["lon"] for p in ring], float), np.array([p["lat"] for p in ring], float))
            out.append([{"x": a, "y": b} for a, b in zip(x, y)])
        return pd.Series(out)

    ring = zones.select("zone_id", project("ring").alias("ring"))
    shifted = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    pairs = ring.select("zone_id", F.explode(F.arrays_zip(F.col("ring").alias("a"), shifted.alias("b"))).alias("e"))
    return pairs.select("zone_id", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def inside(stations: DataFrame, lines: DataFrame, cell: float) -> DataFrame:
    """station_id of stations (x, y) inside a zone of lines, by the parity of its edges to the right.

    A zone's box is covered by at most 16 cells of a grid that fits it; a station meets its own cell of each grid in use, so
    only zones whose box holds the station are tested edge by edge.
    """
    box = lines.groupBy("zone_id").agg(F.min("ax").alias("x0"), F.max("ax").alias("x1"), F.min("ay").alias("y0"), F.max("ay").alias("y1"))
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    box = written(box.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side / (3 * cell), F.lit(1.0))))).cast("int")), "boxes")
    levels = [r[0] for r in box.select("level").distinct().collect()]  # at most the doublings from a cell to the whole extent
    if not levels:
        return stations.select("station_id").limit(0)
    place = lambda c: F.floor(F.col(c) / (cell * F.pow(F.lit(2.0), F.col("level")))).cast("long")
    cells = box.withColumn("cx", F.explode(F.sequence(place("x0"), place("x1")))).withColumn("cy", F.explode(F.sequence(place("y0"), place("y1"))))
    asked = stations.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumns({"cx": place("x"), "cy": place("y")})
    met = asked.join(cells, ["level", "cx", "cy"]).where("x between x0 and x1 and y between y0 and y1").select("station_id", "x", "y", "zone_id")
    cut = (F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))
    crosses = cut & (F.col("x") < (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax"))
    return met.join(lines, "zone_id").groupBy("station_id", "zone_id").agg((F.count_if(crosses) % 2).alias("odd")).where("odd = 1").select("station_id").distinct()


def polygon_distance(stations: DataFrame, lines: DataFrame, cell: float) -> DataFrame:
    """station_id, distance of stations (x, y) to the nearest edge (zone_id, ax, ay, bx, by) of a zone, 0 inside one.

    Edges are cut into pieces of at most half a cell, which lie in the grid by their middle.
    """
    parts = F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / (cell / 2)).cast("int")
    n = F.greatest(parts, F.lit(1))
    along = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * i / F.col("n")
    cuts = lines.select("ax", "ay", "bx", "by").distinct().withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pieces = cuts.select(*(along(f"a{c}", f"b{c}", F.col("i") + s).alias(f"{p}{c}") for p, s in (("p", 0), ("q", 1)) for c in ("x", "y")))
    items = written(pieces.withColumns({"ix": (F.col("px") + F.col("qx")) / 2, "iy": (F.col("py") + F.col("qy")) / 2}), "pieces")
    dx, dy = F.col("qx") - F.col("px"), F.col("qy") - F.col("py")
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.greatest(((F.col("x") - F.col("px")) * dx + (F.col("y") - F.col("py")) * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    best = nearest(stations, items, cell, F.hypot(F.col("x") - F.col("px") - t * dx, F.col("y") - F.col("py") - t * dy), cell / 4)
    within = inside(stations, lines, cell).withColumn("in", F.lit(True))
    return best.join(within, "station_id", "left").select("station_id", F.when(F.col("in"), 0.0).otherwise(F.col("distance")).alias("distance"))


def zone_distance(stations: DataFrame, zones: DataFrame, cell: float = 2000.0) -> DataFrame:
    """station_id, dist_km to the nearest zone, 0 inside one. Stations without coordinates are left out."""

    @F.pandas_udf("x double, y double")
    def project(lng: pd.Series, lat: pd.Series) -> pd.DataFrame:
        x, y = utm(lng.to_numpy(float), lat.to_numpy(float))
        return pd.DataFrame({"x": x, "y": y})

    asked = stations.where("lat is not null and lng is not null").select("station_id", project("lng", "lat").alias("p")).select("station_id", "p.x", "p.y")
    out = polygon_distance(written(asked, "stations"), written(edges(zones), "edges"), cell)
    return out.select("station_id", (F.col("distance") / 1000).alias("dist_km"))
