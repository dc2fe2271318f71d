"""Points in polygons of several rings by an adaptive cover, without moving the points.

The plane is cut into square cells. Of a cell that no edge of a polygon touches all points are alike, so they need no
test; a cell that an edge touches is cut into four, down to a smallest size. What is left on the borders keeps the edges that
a line to the right can cross from within the cell, and only points there are tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside.functions.shapes import edges, inside, meets
from curbside.operators.joins import small
from curbside.sources.paths import checkpointed

#: Side of the largest cells in degrees, and how often they may be halved.
LARGEST, DEPTH = 0.16, 6


def _sized(shapes: Column, x0: Column, y0: Column, size: Column) -> Column:
    """The shapes of a cell as seen from it: which fill it, and which have an edge in it, with the edges that matter."""
    x1, y1 = x0 + size, y0 + size

    def seen(s: Column) -> Column:
        touched = F.exists(s["edges"], lambda e: meets(e, x0, y0, x1, y1))
        full = s["full"] | (~touched & inside(x0 + size / 2, y0 + size / 2, s["edges"]))
        reach = F.filter(s["edges"], lambda e: (F.least(e["y1"], e["y2"]) <= y1) & (F.greatest(e["y1"], e["y2"]) >= y0) & (F.greatest(e["x1"], e["x2"]) >= x0))
        return F.struct(s["position"].alias("position"), s["polygon"].alias("polygon"), full.alias("full"), F.when(~full & touched, reach).otherwise(F.slice(s["edges"], 1, 0)).alias("edges"))

    return F.filter(F.transform(shapes, seen), lambda s: s["full"] | (F.size(s["edges"]) > 0))


def cover(polygons: DataFrame, largest: float = LARGEST, depth: int = DEPTH) -> DataFrame:
    """level, cx, cy, shapes (position, polygon, full, edges): the cells that hold any of ``polygons`` (position, polygon, rings).

    Cells do not overlap: at each place there is one, of the level at which nothing is left to cut.
    """
    shape = F.struct("position", "polygon", F.lit(False).alias("full"), "edges")
    rows = polygons.select("position", "polygon", edges(F.col("rings")).alias("edges")).filter(F.size("edges") > 0)
    # Edges go round, so where they begin are all corners.
    corner = lambda name: F.transform("edges", lambda e: F.floor(e[name] / largest))
    across = F.explode(F.sequence(F.array_min(corner("x1")), F.array_max(corner("x1"))))
    along = F.explode(F.sequence(F.array_min(corner("y1")), F.array_max(corner("y1"))))
    cells = rows.withColumn("cx", across).withColumn("cy", along).groupBy("cx", "cy").agg(F.array_sort(F.collect_list(shape)).alias("shapes"))
    cells = cells.select(F.lit(0).alias("level"), "cx", "cy", _sized(F.col("shapes"), F.col("cx") * largest, F.col("cy") * largest, F.lit(largest)).alias("shapes"))
    for level in range(depth):
        open_ = (F.col("level") == level) & F.exists("shapes", lambda s: ~s["full"])
        size = largest / 2 ** (level + 1)
        cell = lambda dx, dy, k=level: F.struct(F.lit(k + 1).alias("level"), (F.col("cx") * 2 + dx).alias("cx"), (F.col("cy") * 2 + dy).alias("cy"))
        own = F.struct("level", "cx", "cy")
        parts = F.explode(F.when(open_, F.array(*[cell(dx, dy) for dx in (0, 1) for dy in (0, 1)])).otherwise(F.array(own))).alias("cell")
        cells = cells.select(parts, "shapes").select("cell.*", "shapes")
        within = _sized(F.col("shapes"), F.col("cx") * size, F.col("cy") * size, F.lit(size))
        cells = cells.withColumn("shapes", F.when(F.col("level") == level + 1, within).otherwise(F.col("shapes")))
    return cells.filter(F.size("shapes") > 0)


def in_polygons(points: DataFrame, polygons: DataFrame, largest: float = LARGEST, depth: int = DEPTH) -> DataFrame:
    """``points`` (lon, lat, ...) with the first (by ``position``) of ``polygons`` that holds them, or null, as ``polygon``.

    ``polygons``: position, polygon, rings (parts and holes together). A point on a border belongs to the polygon on its right and
    above. The cover is joined level by level; where it has few rows, which is checked, it is broadcast, and points stay
    where they are. Points without a place are in no polygon.
    """
    cells = checkpointed(cover(polygons, largest, depth))  # it is read once for each level
    out = points
    for level in range(depth + 1):
        size = largest / 2**level
        own = cells.filter(F.col("level") == level).select(F.col("cx").alias(f"_x{level}"), F.col("cy").alias(f"_y{level}"), F.col("shapes").alias(f"_s{level}"))
        out = out.withColumns({f"_x{level}": F.floor(F.col("lon") / size), f"_y{level}": F.floor(F.col("lat") / size)}).join(small(own), [f"_x{level}", f"_y{level}"], "left")
    found = F.coalesce(*[F.col(f"_s{k}") for k in range(depth + 1)])
    holding = F.filter("_found", lambda s: s["full"] | inside(F.col("lon"), F.col("lat"), s["edges"]))
    out = out.withColumn("_found", found).withColumn("polygon", F.get(holding, F.lit(0))["polygon"])
    return out.select(*[F.col(c) for c in points.columns], "polygon")

