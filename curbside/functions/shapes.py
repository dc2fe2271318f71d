"""Rings, polygons of several rings, clipping and areas as Column expressions.

A ring is array<struct<lon,lat>>, closed or not. A shape is an array of rings: all parts and all holes of a multipolygon
together. By the even-odd rule a point is in the shape if a line from it crosses an odd number of edges of all rings, so
holes need no mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rings with less than this area, in square degrees, are what clipping leaves of a ring that only touches the rectangle.
LEAST_AREA = 1e-12


def _pairs(ring: Column, make) -> Column:
    """``make(a, b)`` for each edge of a ring, the closing one included."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), make)


def edges(rings: Column) -> Column:
    """array<struct<x1,y1,x2,y2>> of all edges of a shape."""
    edge = lambda a, b: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2"))
    return F.flatten(F.transform(rings, lambda r: _pairs(r, edge)))


def inside(lon: Column, lat: Column, of: Column) -> Column:
    """Whether a point lies within the shape of these :func:`edges`; only those to its right count."""

    def crosses(e: Column) -> Column:
        at = (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        return F.when((e["y1"] > lat) != (e["y2"] > lat), lon < at).otherwise(False)

    return F.size(F.filter(of, crosses)) % 2 == 1


def meets(e: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether an edge touches a rectangle: their boxes meet, and not all corners lie on one side of the edge."""
    boxes = (F.least(e["x1"], e["x2"]) <= x1) & (F.greatest(e["x1"], e["x2"]) >= x0) & (F.least(e["y1"], e["y2"]) <= y1) & (F.greatest(e["y1"], e["y2"]) >= y0)
    side = lambda x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    sides = [side(x, y) for x in (x0, x1) for y in (y0, y1)]
    return boxes & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def area(rings: Column) -> Column:
    """Area of a shape whose holes run the other way round than the rings around them, in square degrees."""
    return F.abs(F.aggregate(F.transform(rings, lambda r: _twice(r)), F.lit(0.0), lambda s, v: s + v)) / 2


def _twice(ring: Column) -> Column:
    """Twice the area of a ring, negative if it runs with the clock."""
    return F.aggregate(_pairs(ring, lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"]), F.lit(0.0), lambda s, v: s + v)


def _cut(ring: Column, axis: str, bound: Column, above: bool) -> Column:
    """The part of a ring on one side of a line (Sutherland and Hodgman): corners on that side, and where edges cross it."""
    other = "lat" if axis == "lon" else "lon"
    within = lambda p: p[axis] >= bound if above else p[axis] <= bound

    def step(a: Column, b: Column) -> Column:
        at = a[other] + (b[other] - a[other]) * (bound - a[axis]) / (b[axis] - a[axis])
        crossing = F.struct((bound if axis == "lon" else at).alias("lon"), (at if axis == "lon" else bound).alias("lat"))
        corner = F.struct(b["lon"].alias("lon"), b["lat"].alias("lat"))
        return (
            F.when(within(a) & within(b), F.array(corner)).when(within(a), F.array(crossing)).when(within(b), F.array(crossing, corner)).otherwise(F.slice(F.array(corner), 1, 0))
        )

    return F.flatten(_pairs(ring, step))


def clipped(df: DataFrame, rings: str, west: Column | float, south: Column | float, east: Column | float, north: Column | float) -> DataFrame:
    """``df`` with the shapes of column ``rings`` cut to a rectangle; rings of which nothing is left, or a line only, are dropped.

    A ring that leaves the rectangle and comes back runs along its side in between, which changes no area. One step for
    each side, so that no expression is repeated within another.
    """

    def one_side(axis: str, bound: Column | float, above: bool) -> Column:
        at = bound if isinstance(bound, Column) else F.lit(float(bound))
        return F.filter(F.transform(rings, lambda r: _cut(r, axis, at, above)), lambda r: F.abs(_twice(r)) > 2 * LEAST_AREA)

    for side in (("lon", west, True), ("lon", east, False), ("lat", south, True), ("lat", north, False)):
        df = df.withColumn(rings, one_side(*side))
    return df
