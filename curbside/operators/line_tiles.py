"""Lines and polygons as vector tiles: dealt to the tiles they reach, clipped with a margin, written tile by tile.

Every feature is dealt to tiles by its own box, thinned for the zoom if wanted, clipped to the tile and its margin and turned into whole pixels, all in
one pass over the features. Spark then brings the features of a tile together, in order; they are written into the tile's
bytes as they come, so that a task holds one tile at a time. Layers of one tile follow one another.
"""

from __future__ import annotations

import heapq
import math
import struct
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.functions.geo import HALF_WORLD, MAX_LATITUDE
from curbside.operators.joins import small
from curbside.operators.vector_tiles import EXTENT, field, varint, zigzag

Points = list[tuple[float, float]]
POINT, LINE, POLYGON = 1, 2, 3
# By the highest zoom, the part of a tile's width whose square is the least area that a corner must span.
TOLERANCES = ((9, 6.0), (11, 12.0), (13, 24.0), (15, 48.0))


def tolerance(zoom: int) -> float:
    """Least effective area at a zoom for :func:`thinned`, in square metres of the map; 0 beyond the last step."""
    width = 2 * HALF_WORLD / 2**zoom
    return next((width / part for most, part in TOLERANCES if zoom <= most), 0.0)


def mercator(lon: float, lat: float) -> tuple[float, float]:
    lat = max(-MAX_LATITUDE, min(MAX_LATITUDE, lat))
    return lon * HALF_WORLD / 180, math.log(math.tan(math.radians(lat) / 2 + math.pi / 4)) * HALF_WORLD / math.pi


def thinned(points: Points, least: float, fewest: int = 2) -> Points:
    """Visvalingam and Whyatt: the corner that spans the least area with its neighbours goes first, until all span ``least``
    or ``fewest`` are left. A corner never counts for less than one that went before it. Ends stay. Equal areas go by place."""
    if least <= 0 or len(points) <= fewest:
        return points
    before, after = list(range(-1, len(points) - 1)), list(range(1, len(points) + 1))

    def area(k: int) -> float:
        (x1, y1), (x2, y2), (x3, y3) = points[before[k]], points[k], points[after[k]]
        return abs((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) / 2

    current = {k: area(k) for k in range(1, len(points) - 1)}
    heap = [(a, k) for k, a in current.items()]
    heapq.heapify(heap)
    left = len(points)
    while heap and left > fewest:
        a, k = heapq.heappop(heap)
        if current.get(k) != a:
            continue
        if a >= least:
            break
        del current[k]
        left -= 1
        after[before[k]], before[after[k]] = after[k], before[k]
        for n in (before[k], after[k]):
            if n in current:
                current[n] = max(a, area(n))
                heapq.heappush(heap, (current[n], n))
    return [p for k, p in enumerate(points) if k in (0, len(points) - 1) or k in current]


def clipped_line(points: Points, low: float, high: float) -> list[Points]:
    """The stretches of a line within the square from ``low`` to ``high`` (Liang and Barsky for each edge)."""
    out: list[Points] = []
    for (x1, y1), (x2, y2) in zip(points, points[1:], strict=False):
        dx, dy, a, b = x2 - x1, y2 - y1, 0.0, 1.0
        for p, q in ((-dx, x1 - low), (dx, high - x1), (-dy, y1 - low), (dy, high - y1)):
            if p == 0:
                if q < 0:
                    a, b = 1.0, 0.0
            elif p < 0:
                a = max(a, q / p)
            else:
                b = min(b, q / p)
        if a <= b:
            begin, end = (x1 + a * dx, y1 + a * dy) if a > 0 else (x1, y1), (x1 + b * dx, y1 + b * dy) if b < 1 else (x2, y2)
            if out and a == 0 and out[-1][-1] == begin:
                out[-1].append(end)
            else:
                out.append([begin, end])
    return out


def clipped_ring(points: Points, low: float, high: float) -> Points:
    """What of a ring (not closed) lies within the square (Sutherland and Hodgman)."""
    for axis, bound, above in ((0, low, True), (0, high, False), (1, low, True), (1, high, False)):
        out: Points = []
        for a, b in zip([points[-1], *points[:-1]] if points else [], points, strict=True):
            ins = [p[axis] >= bound if above else p[axis] <= bound for p in (a, b)]
            if ins[0] != ins[1]:
                other = a[1 - axis] + (b[1 - axis] - a[1 - axis]) * (bound - a[axis]) / (b[axis] - a[axis])
                out.append((bound, other) if axis == 0 else (other, bound))
            if ins[1]:
                out.append(b)
        points = out
    return points


def ring_area(ring: list[tuple[int, int]]) -> float:
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], *ring[:1]], strict=True)) / 2


def _without_repeats(points: Points) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in points:
        p = math.floor(x + 0.5), math.floor(y + 0.5)
        if not out or out[-1] != p:
            out.append(p)
    return out


def in_tile(parts: list[Points], kind: int, zoom: int, x: int, y: int, margin: int) -> list[list[tuple[int, int]]]:
    """Parts (map metres) in pixels of a tile, clipped; rings with the interior on the side that the format wants: outer rings have a positive
    area with y downwards, holes (rings that ran with the clock on the map) a negative one."""
    size = 2 * HALF_WORLD / 2**zoom
    west, north = x * size - HALF_WORLD, HALF_WORLD - y * size
    out = []
    for part in parts:
        placed = [((px - west) / size * EXTENT, (north - py) / size * EXTENT) for px, py in part]
        if kind == LINE:
            found = [_without_repeats(p) for p in clipped_line(placed, -margin, EXTENT + margin)]
            out += [p for p in found if len(p) > 1]
        else:
            ring = _without_repeats(clipped_ring(placed[:-1] if placed[0] == placed[-1] else placed, -margin, EXTENT + margin))
            ring = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
            if len(ring) > 2 and ring_area(ring):
                hole = sum(a * d - c * b for (a, b), (c, d) in zip(part, [*part[1:], part[0]], strict=True)) < 0
                out.append(ring if (ring_area(ring) < 0) == hole else ring[::-1])
    return out


def commands(parts: list[list[tuple[int, int]]], kind: int) -> bytes:
    """MoveTo, LineTo and, for rings, ClosePath, each place relative to the one before."""
    out, x, y = [], 0, 0
    for part in parts:
        for k, (px, py) in enumerate(part):
            if k == 0:
                out.append(1 << 3 | 1)
            elif k == 1:
                out.append(len(part) - 1 << 3 | 2)
            out += [zigzag(px - x), zigzag(py - y)]
            x, y = px, py
        if kind == POLYGON:
            out.append(1 << 3 | 7)
    return b"".join(map(varint, out))


class Tile:
    """A tile that is written feature by feature; the layers are those of the features, in their order."""

    def __init__(self):
        self.done, self.name, self.n = b"", None, 0

    def add(self, name: str, kind: int, geometry: bytes, properties: dict[str, int | float | str]) -> None:
        if name != self.name:
            self.close()
            self.name, self.keys, self.values, self.features = name, {}, {}, bytearray()
        tags = []
        for key, value in properties.items():
            if isinstance(value, str):
                coded = field(1, value.encode())
            else:
                coded = varint(6 << 3) + varint(zigzag(value)) if isinstance(value, int) else varint(3 << 3 | 1) + struct.pack("<d", value)
            tags += [self.keys.setdefault(key, len(self.keys)), self.values.setdefault(coded, len(self.values))]
        self.features += field(2, field(2, b"".join(map(varint, tags))) + varint(3 << 3) + varint(kind) + field(4, geometry))
        self.n += 1

    def close(self) -> bytes:
        if self.name is not None:
            body = varint(15 << 3) + varint(2) + field(1, self.name.encode()) + bytes(self.features)
            body += b"".join(field(3, k.encode()) for k in self.keys) + b"".join(field(4, v) for v in self.values)
            self.done += field(3, body + varint(5 << 3) + varint(EXTENT))
            self.name = None
        return self.done


def _tiles_of(points: Points, size: float, reach: float, most: int) -> Iterator[tuple[int, int]]:
    """Tiles of side ``size`` that the box of some points and ``reach`` around it meets."""
    xs, ys = zip(*points, strict=True)
    span = lambda low, high: range(max(0, math.floor((low - reach) / size)), min(most - 1, math.floor((high + reach) / size)) + 1)
    for x in span(min(xs) + HALF_WORLD, max(xs) + HALF_WORLD):
        for y in span(HALF_WORLD - max(ys), HALF_WORLD - min(ys)):
            yield x, y


_DEALT = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("layer", pa.string()), ("id", pa.int64()), ("n", pa.int64()), ("kind", pa.int32()), ("geometry", pa.binary())])


def _dealt(zoom: int, margin: int, thin: bool):
    """Features (layer, kind, id, n, parts in degrees) as (x, y, layer, id, n, kind, geometry), once for each tile they reach."""
    size, least = 2 * HALF_WORLD / 2**zoom, tolerance(zoom) if thin else 0.0
    reach = size * margin / EXTENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for layer, kind, ident, n, parts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                placed = [thinned([mercator(p["lon"], p["lat"]) for p in part], least, 2 if kind == LINE else 4) for part in parts if len(part) > 1]
                if not placed:
                    continue
                # A line is dealt by its edges, so that one across the map is not tried in every tile between its ends.
                boxes = [pair for part in placed for pair in zip(part, part[1:], strict=False)] if kind == LINE else [[p for part in placed for p in part]]
                for x, y in sorted({t for box in boxes for t in _tiles_of(box, size, reach, 2**zoom)}):
                    if found := in_tile(placed, kind, zoom, x, y, margin):
                        rows.append((x, y, layer, ident, n, kind, commands(found, kind)))
            columns = zip(*rows, strict=True) if rows else [()] * len(_DEALT)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _DEALT.types, strict=True)], schema=_DEALT)

    return run


def written(zoom: int, features: Callable[[pd.DataFrame], Iterator[tuple]]):
    """Frames whose rows come tile by tile as tiles; ``features`` gives (x, y) and what :meth:`Tile.add` takes for each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tile = None, Tile()
        row = lambda: pd.DataFrame({"z": [zoom], "x": [at[0]], "y": [at[1]], "n_features": [tile.n], "mvt": [tile.close()]})
        for frame in frames:
            for place, feature in features(frame):
                if at != place:
                    if at:
                        yield row()
                    at, tile = place, Tile()
                tile.add(*feature)
        if at:
            yield row()

    return run


def shape_tiles(features: DataFrame, zoom: int, margin: int = 64, thin: bool = False, asked: DataFrame | None = None) -> DataFrame:
    """z, x, y, n_features, mvt of every tile that ``features`` reach; with ``asked`` (x, y) of those tiles only.

    ``features``: layer, kind (LINE or POLYGON), id (long), n (long), parts (array<array<struct<lon,lat>>>: the lines, or the rings with holes
    running the other way round). Clipped to the tile and ``margin`` pixels of 4096; with ``thin`` corners that span less
    than :func:`tolerance` of the zoom go first. Within a tile layers go by name and features by id.
    """
    dealt = features.select("layer", F.col("kind").cast("int").alias("kind"), F.col("id").cast("long").alias("id"), F.col("n").cast("long").alias("n"), "parts")
    dealt = dealt.mapInArrow(_dealt(zoom, margin, thin), "x long, y long, layer string, id long, n long, kind int, geometry binary")
    if asked is not None:
        dealt = dealt.join(small(asked.select("x", "y").distinct()), ["x", "y"], "left_semi")

    def rows(frame: pd.DataFrame) -> Iterator[tuple]:
        for x, y, layer, ident, n, kind, geometry in zip(*[frame[c].tolist() for c in ("x", "y", "layer", "id", "n", "kind", "geometry")], strict=True):
            yield (x, y), (layer, kind, geometry, {"id": ident, "count": n})

    return dealt.repartition("x", "y").sortWithinPartitions("x", "y", "layer", "id").mapInPandas(written(zoom, rows), "z int, x long, y long, n_features int, mvt binary")


def read_tile(tile: bytes) -> list[dict]:
    """Features of a tile: layer, kind, parts (places in pixels) and properties; to check what was written."""

    def number(data: bytes, at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, at

    def numbers(data: bytes) -> list[int]:
        out, at = [], 0
        while at < len(data):
            value, at = number(data, at)
            out.append(value)
        return out

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0
        while at < len(data):
            tag, at = number(data, at)
            if tag & 7 == 2:
                size, at = number(data, at)
                yield tag >> 3, data[at : at + size]
                at += size
            else:
                value, at = number(data, at)
                yield tag >> 3, value

    plain = lambda n: n >> 1 if n % 2 == 0 else -(n + 1 >> 1)
    out = []
    for _, body in fields(tile):
        own = list(fields(body))
        keys = [v.decode() for k, v in own if k == 3]
        values = [next((v.decode() if j == 1 else plain(v)) for j, v in fields(w)) for k, w in own if k == 4]
        for feature in (dict(fields(v)) for k, v in own if k == 2):
            parts, x, y, at, data = [], 0, 0, 0, numbers(feature[4])
            while at < len(data):
                command, times = data[at] & 7, data[at] >> 3
                at += 1
                for _ in range(times if command != 7 else 0):
                    x, y, at = x + plain(data[at]), y + plain(data[at + 1]), at + 2
                    if command == 1:
                        parts.append([])
                    parts[-1].append((x, y))
            tags = numbers(feature[2])
            out.append({"layer": next(v for k, v in own if k == 1).decode(), "kind": feature[3], "parts": parts, **{keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=True)}})
    return out
