"""Web-Mercator tiles, quadkeys, distances and simple shapes as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latitude at which the Mercator square ends; half the length of the equator in metres.
MAX_LATITUDE, HALF_WORLD = 85.05112878, 20037508.342789244
#: Metres in a degree of latitude, and of longitude at Toronto's latitude.
METRES_LAT, METRES_LON = 111_320.0, 78_850.0


def tile_x(lon: Column, zoom: Column | int) -> Column:
    n = F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom)
    return F.least(F.greatest(F.floor((lon + 180) / 360 * n), F.lit(0)), n.cast("bigint") - 1).cast("bigint")


def tile_y(lat: Column, zoom: Column | int) -> Column:
    n = F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom)
    phi = F.radians(F.least(F.greatest(lat, F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE)))
    y = (1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2
    return F.least(F.greatest(F.floor(y * n), F.lit(0)), n.cast("bigint") - 1).cast("bigint")


def mercator_x(lon: Column) -> Column:
    return lon * (HALF_WORLD / 180)


def mercator_y(lat: Column) -> Column:
    phi = F.radians(F.least(F.greatest(lat, F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE)))
    return F.ln(F.tan(phi / 2 + math.pi / 4)) * (HALF_WORLD / math.pi)


def quadkey(x: Column, y: Column, zoom: int) -> Column:
    """Digits from the widest zoom to ``zoom``: bit of x plus twice the bit of y."""
    bit = lambda c, k: F.shiftright(c, k).bitwiseAND(F.lit(1))
    return F.concat(*[(bit(x, k) + 2 * bit(y, k)).cast("string") for k in range(zoom - 1, -1, -1)])


def quadkey_tile(key: Column) -> Column:
    """struct(z, x, y) of a quadkey."""
    digits = F.transform(F.split(key, ""), lambda d: d.cast("int"))
    add = lambda of: F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, d: a * 2 + of(d).cast("bigint"))
    return F.struct(F.length(key).alias("z"), add(lambda d: d.bitwiseAND(F.lit(1))).alias("x"), add(lambda d: F.shiftright(d, 1)).alias("y"))


def tile_envelope(z: Column, x: Column, y: Column) -> Column:
    """struct(xmin, ymin, xmax, ymax) of a tile in Mercator metres."""
    size = F.lit(2 * HALF_WORLD) / F.pow(F.lit(2.0), z)
    return F.struct((x * size - HALF_WORLD).alias("xmin"), (HALF_WORLD - (y + 1) * size).alias("ymin"), ((x + 1) * size - HALF_WORLD).alias("xmax"), (HALF_WORLD - y * size).alias("ymax"))


def neighbour_tiles(z: Column, x: Column, y: Column) -> Column:
    """The tiles around a tile: x wraps, y is clamped; the tile itself is left out."""
    n = F.call_function("shiftleft", F.lit(1).cast("bigint"), z.cast("int"))
    around = [F.struct(z.alias("z"), F.pmod(x + dx, n).alias("x"), F.least(F.greatest(y + dy, F.lit(0)), n - 1).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    return F.filter(F.array_distinct(F.array(*around)), lambda t: ~((t["x"] == x) & (t["y"] == y)))


def child_tiles(z: Column, x: Column, y: Column) -> Column:
    return F.array(*[F.struct((z + 1).alias("z"), (x * 2 + dx).alias("x"), (y * 2 + dy).alias("y")) for dy in (0, 1) for dx in (0, 1)])


def flat_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a flat map, good within one city."""
    return F.hypot((lat1 - lat2) * METRES_LAT, (lon1 - lon2) * METRES_LON)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6_371_000.0 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def line_centroid(points: Column) -> Column:
    """Mean of the vertices of array<struct<lon,lat>>."""
    mean = lambda name: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[name], lambda a: a / F.size(points))
    return F.struct(mean("lon").alias("lon"), mean("lat").alias("lat"))


def bounding_box(points: Column) -> Column:
    lon, lat = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return F.struct(F.array_min(lon).alias("min_lon"), F.array_min(lat).alias("min_lat"), F.array_max(lon).alias("max_lon"), F.array_max(lat).alias("max_lat"))


def glow_segments(lon: Column, lat: Column, intensity: Column) -> Column:
    """Four crossing lines through a point; the brighter the point, the longer."""
    # Shortest line in metres, the intensity beyond which it grows no longer, metres for each unit, and the angles.
    length = 90 + F.least(intensity, F.lit(2500)) * 0.012
    lines = []
    for angle in (0, 45, 90, 135):
        dx, dy = length / 2 * math.cos(math.radians(angle)) / METRES_LON, length / 2 * math.sin(math.radians(angle)) / METRES_LAT
        lines.append(F.struct(F.lit(angle).alias("angle"), (lon - dx).alias("lon1"), (lat - dy).alias("lat1"), (lon + dx).alias("lon2"), (lat + dy).alias("lat2")))
    return F.array(*lines)


def snapped(c: Column, grid: float) -> Column:
    return F.round(c / grid) * grid
