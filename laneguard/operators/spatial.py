"""Nearest neighbours on the globe by a grid of growing cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneguard.functions.numeric import haversine_nm
from laneguard.session import materialize

SIZES = [2.0 ** -k for k in range(12, -3, -2)]
"""Edges of the cubes that divide the space around the unit sphere: about 0.8 nm, each four times the one before, up to all of it."""
CELL_ROWS = 64
"""The search begins at the largest cells of which none holds more points of a group."""


def _on_sphere(points: DataFrame) -> DataFrame:
    lat, lon = F.radians("lat"), F.radians("lon")
    return points.withColumn("x", F.cos(lat) * F.cos(lon)).withColumn("y", F.cos(lat) * F.sin(lon)).withColumn("z", F.sin(lat))


def _cell(axis: str, size: float) -> Column:
    return F.floor((F.col(axis) + 1) / size)


def _start(points: DataFrame) -> int:
    """Index of the first size to search with, from one aggregation over all sizes."""
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), *[_cell(a, s).alias("c" + a) for a in "xyz"]) for i, s in enumerate(SIZES)]))
    cells = points.select("grp", levels.alias("c")).groupBy("grp", "c").agg(F.count(F.lit(1)).alias("n"))
    most = {r["level"]: r["n"] for r in cells.groupBy("c.level").agg(F.max("n").alias("n")).collect()}
    return max([i for i, n in most.items() if n <= CELL_ROWS], default=0)


def nearest_in_group(asked: DataFrame, points: DataFrame) -> DataFrame:
    """``id, other, nm``: for every row of ``asked(id, grp, lat, lon)`` the closest other of ``points`` with its ``grp``.

    In each round the rows that are still open meet the points of the 27 cells around their own by an equality join. A
    neighbour found within one cell edge is final. Rows that stay open have no neighbour within that edge, so few of
    them are near each other and each point is looked at by a bounded number of them when the cells grow; the last cell
    holds the whole globe. Equal distances: the smaller id. Rows without others in their group are not returned.
    """
    points = materialize(_on_sphere(points.filter("lat IS NOT NULL AND lon IS NOT NULL")), "grid-points")
    open_ = _on_sphere(asked.filter("lat IS NOT NULL AND lon IS NOT NULL"))
    done = []
    for i in range(_start(points), len(SIZES)):
        size = SIZES[i]
        near = F.explode(F.array(*[F.struct(*[(_cell(a, size) + d).alias("c" + a) for a, d in zip("xyz", (dx, dy, dz))]) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1)]))
        there = points.select(F.col("id").alias("other"), "grp", F.struct(*[_cell(a, size).alias("c" + a) for a in "xyz"]).alias("cell"), *[F.col(c).alias("o_" + c) for c in ("lat", "lon", "x", "y", "z")])
        met = open_.select("*", near.alias("cell")).join(there, ["grp", "cell"]).filter("id != other")
        chord = F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(a) - F.col("o_" + a), 2.0) for a in "xyz"]))
        last = i == len(SIZES) - 1
        close = met if last else met.filter(chord <= size * (1 - 1e-9))
        nm = haversine_nm(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon"))
        found = close.groupBy("id").agg(F.min(F.struct(nm.alias("nm"), "other")).alias("best"))
        found = materialize(found.select("id", "best.other", "best.nm"), "grid-found")
        done.append(found)
        if not last:
            open_ = materialize(open_.join(found, "id", "left_anti"), "grid-open")
            if open_.isEmpty():
                break
    return reduce(DataFrame.unionAll, done)
