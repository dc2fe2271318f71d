"""Map tiles: which tile a point falls in, tile tables by quadkey, cluster and sample layers, glow lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.functions.geo import mercator_x, mercator_y, quadkey, tile_envelope, tile_x, tile_y
from curbside.operators.aggregates import grid_clusters
from curbside.operators.sampling import hash_ordered

#: (highest zoom, layer, grid in metres): what a tile shows by zoom.
LAYERS = ((8, "cluster", 1000.0), (10, "cluster", 500.0), (12, "sample", None), (24, "points", None))


def layer_of(zoom: int) -> tuple[str, float | None]:
    return next((kind, grid) for most, kind, grid in LAYERS if zoom <= most)


def tiled(points: DataFrame, zoom: int) -> DataFrame:
    """Adds x, y, quadkey and tile_group (first digit), the columns that tile tables are partitioned and sorted by."""
    placed = points.withColumns({"x": tile_x(F.col("lon"), zoom), "y": tile_y(F.col("lat"), zoom)})
    placed = placed.withColumn("quadkey", quadkey(F.col("x"), F.col("y"), zoom))
    return placed.withColumn("tile_group", F.left("quadkey", F.lit(1)))


def covering(points: DataFrame, zooms: Sequence[int]) -> DataFrame:
    """The distinct tiles that hold points, at each zoom."""
    at = points.select("lon", "lat", F.explode(F.array(*map(F.lit, zooms))).alias("z"))
    return at.select("z", tile_x(F.col("lon"), F.col("z")).alias("x"), tile_y(F.col("lat"), F.col("z")).alias("y")).distinct()


def write_tiles(points: DataFrame, zoom: int, path: str) -> None:
    """Points in order of their quadkeys, one folder for each first digit, so that prefixes skip files and row groups."""
    tiled(points, zoom).repartitionByRange("tile_group", "quadkey").sortWithinPartitions("tile_group", "quadkey").write.mode("overwrite").partitionBy("tile_group").parquet(path)


def tile_features(points: DataFrame, tiles: DataFrame, zoom: int, limit: int = 500) -> DataFrame:
    """What the tiles (z, x, y; all of one zoom) show, one row for each feature: kind, n, amount, lon, lat.

    ``points``: point_key, lon, lat, amount. Tiles and points meet by the tile a point falls in.
    """
    kind, grid = layer_of(zoom)
    placed = tiled(points, zoom).join(tiles.select("x", "y").distinct(), ["x", "y"])
    if kind == "cluster":
        metres = placed.withColumns({"mx": mercator_x(F.col("lon")), "my": mercator_y(F.col("lat"))})
        cells = metres.withColumns({"cx": F.floor(F.col("mx") / grid), "cy": F.floor(F.col("my") / grid)})
        out = cells.groupBy("x", "y", "cx", "cy").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
        return out.select("x", "y", F.lit(kind).alias("kind"), "n", "amount", "lon", "lat")
    if kind == "sample":
        from curbside.operators.windows import top_per_group

        order = F.conv(F.substring(F.md5(F.col("point_key").cast("string")), 1, 8), 16, 10).cast("bigint")
        placed = top_per_group(placed, ["x", "y"], [order, "point_key"], limit).drop("rn")
    return placed.select("x", "y", F.lit(kind).alias("kind"), F.lit(1).cast("bigint").alias("n"), "amount", "lon", "lat")


def pixels(features: DataFrame, zoom: int, extent: int = 4096) -> DataFrame:
    """Adds px, py: places within the tile in units of ``extent``, y downwards."""
    box = tile_envelope(F.lit(zoom), F.col("x"), F.col("y"))
    size = box["xmax"] - box["xmin"]
    px, py = (mercator_x(F.col("lon")) - box["xmin"]) / size, (box["ymax"] - mercator_y(F.col("lat"))) / size
    return features.withColumns({"px": F.floor(px * extent).cast("int"), "py": F.floor(py * extent).cast("int")})


def pyramid(points: DataFrame, zooms: Sequence[int], base_grid: float) -> DataFrame:
    """Grid clusters for every zoom, cells halving from one to the next: an approximation of greedy clustering."""
    metres = points.withColumns({"mx": mercator_x(F.col("lon")), "my": mercator_y(F.col("lat"))})
    low = min(zooms)
    sizes = {z: base_grid / 2 ** (z - low) for z in zooms}
    clusters = grid_clusters(metres, list(sizes.values()))
    zoom = F.coalesce(*[F.when(F.col("grid_metres") == g, F.lit(z)) for z, g in sizes.items()])
    return clusters.withColumn("zoom", zoom)


def viewport(points: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    return points.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def sampled(points: DataFrame, limit: int) -> DataFrame:
    """A stable sample with the number of points there are and whether it leaves some out."""
    available = points.agg(F.count("*").alias("available"))
    return hash_ordered(points, "point_key", limit).crossJoin(F.broadcast(available)).withColumn("partial", F.col("available") > limit)
