"""Pure column expressions over arrays of points ``array<struct<x, y>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BBOX = "struct<xmin:float,xmax:float,ymin:float,ymax:float>"


def snapped(value: Column) -> Column:
    """A coordinate at seven decimals, halves upwards as the geometry library rounds."""
    return F.floor(value * F.lit(1e7) + F.lit(0.5)).cast("double") / F.lit(1e7)


def is_closed(points: Column) -> Column:
    """First equals last; null for no points."""
    return F.get(points, F.lit(0)) == F.element_at(points, -1)


def bbox(points: Column) -> Column:
    """Bounding box as FLOATs; null for no points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    box = F.struct(
        F.array_min(xs).cast("float").alias("xmin"),
        F.array_max(xs).cast("float").alias("xmax"),
        F.array_min(ys).cast("float").alias("ymin"),
        F.array_max(ys).cast("float").alias("ymax"),
    )
    return F.when(F.size(points) > 0, box)


def _pairs(points: Column) -> Column:
    return F.arrays_zip(F.slice(points, 1, F.size(points) - 1).alias("a"), F.slice(points, 2, F.size(points) - 1).alias("b"))


def length(points: Column) -> Column:
    """Planar length in degrees; 0 for one point."""
    step = lambda s, p: s + F.sqrt(F.pow(p["b"]["x"] - p["a"]["x"], F.lit(2.0)) + F.pow(p["b"]["y"] - p["a"]["y"], F.lit(2.0)))
    return F.when(F.size(points) > 1, F.aggregate(_pairs(points), F.lit(0.0), step)).when(F.size(points) == 1, F.lit(0.0))


def ring_area(points: Column) -> Column:
    """Shoelace area of a closed ring (positive if counter-clockwise); null unless closed."""
    step = lambda s, p: s + (p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"])
    return F.when((F.size(points) > 3) & is_closed(points), F.aggregate(_pairs(points), F.lit(0.0), step) / 2)
