"""Clusters of points within a radius, zoom by zoom: no two centres are nearer than the radius, and every point is near one.

The plane is cut into cells so small that two points of one cell are always within the radius; so a cell holds at most one
centre. In each round every cell offers the undecided point with the least rank (a hash of its key). An offer becomes a centre if no offer within the
radius has a lesser rank, and all points within the radius of a centre are decided. No points are paired with
one another: offers meet the offers of 24 cells around, and points the centres of as many.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside.sources.paths import checkpointed


def _cells(df: DataFrame, radius: float) -> DataFrame:
    side = radius / math.sqrt(2)
    return df.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})


def _around(df: DataFrame, *columns: str) -> DataFrame:
    """Rows repeated for each of the 25 cells that a point within the radius may lie in; ``columns`` with an underscore."""
    steps = F.array(*[F.struct((F.col("cx") + a).alias("cx"), (F.col("cy") + b).alias("cy")) for a in range(-2, 3) for b in range(-2, 3)])
    return df.select(F.explode(steps).alias("at"), *[F.col(c).alias(f"_{c}") for c in columns]).select("at.cx", "at.cy", *[f"_{c}" for c in columns])


def _near(radius: float) -> Column:
    return (F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2 <= radius * radius


def centres(points: DataFrame, radius: float, max_rounds: int = 60) -> DataFrame:
    """key, x, y, rank, cx, cy of the centres of ``points`` (key, x, y). Keys differ; equal ranks go by key."""
    left = checkpointed(_cells(points.select("key", "x", "y", F.xxhash64("key").alias("rank")), radius))
    found = None
    for _ in range(max_rounds):
        first = left.groupBy("cx", "cy").agg(F.min(F.struct("rank", "key", "x", "y")).alias("o"))
        offers = checkpointed(first.select("o.*", "cx", "cy"))
        if offers.isEmpty():
            return found if found is not None else offers.select("key", "x", "y", "rank", "cx", "cy")
        better = F.struct("_rank", "_key") < F.struct("rank", "key")
        beaten = offers.join(_around(offers, "rank", "key", "x", "y"), ["cx", "cy"]).filter(better & _near(radius)).select("key").distinct()
        chosen = checkpointed(offers.join(beaten, "key", "left_anti").select("key", "x", "y", "rank", "cx", "cy"))
        decided = left.join(_around(chosen, "x", "y"), ["cx", "cy"]).filter(_near(radius)).select("key").distinct()
        left = checkpointed(left.join(decided, "key", "left_anti"))
        found = chosen if found is None else found.unionAll(chosen)
    raise RuntimeError(f"clusters did not settle in {max_rounds} rounds")


def clustered(points: DataFrame, radius: float) -> DataFrame:
    """key, x, y, n, amount of the clusters of ``points`` (key, x, y, n, amount): each point belongs to the centre of the least rank within
    ``radius``; a cluster has the key of its centre, lies at the mean of its points weighted by n, and keeps their sums."""
    chosen = centres(points, radius)
    met = _cells(points, radius).join(_around(chosen, "rank", "key", "x", "y"), ["cx", "cy"]).filter(_near(radius))
    owned = met.groupBy("key", "x", "y", "n", "amount").agg(F.min(F.struct("_rank", "_key")).alias("owner"))
    sums = owned.groupBy(F.col("owner._key").alias("key")).agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("y"), F.sum("n").alias("n"), F.sum("amount").alias("amount"))
    return sums


def zoomed(points: DataFrame, zooms: Sequence[int], radius: float) -> DataFrame:
    """Clusters of every zoom, from the highest down: those of one zoom are the points of the next. ``radius`` holds at zoom 0 and halves with each zoom."""
    out, rows = None, points
    for zoom in sorted(zooms, reverse=True):
        rows = checkpointed(clustered(rows, radius / 2**zoom))
        level = rows.withColumn("zoom", F.lit(zoom))
        out = level if out is None else out.unionByName(level)
    return out
