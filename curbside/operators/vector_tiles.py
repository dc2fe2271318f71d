"""Vector tiles: features of a tile encoded in the Mapbox Vector Tile format.

The wire format is a few tagged fields, so a small writer is enough; Spark deals tiles to tasks and brings each tile's
features there in order.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.operators.tiles import pixels, tile_features

EXTENT = 4096


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, payload: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def layer(name: str, points: list[tuple[int, int, dict]]) -> bytes:
    """One layer of points with properties."""
    keys: dict[str, int] = {}
    values: dict[bytes, int] = {}
    features = b""
    for x, y, properties in points:
        tags = []
        for key, value in properties.items():
            if value is None:
                continue
            if isinstance(value, str):
                coded = field(1, value.encode())
            elif isinstance(value, int):
                coded = varint(6 << 3) + varint(zigzag(value))
            else:
                coded = varint(3 << 3 | 1) + struct.pack("<d", float(value))
            tags += [keys.setdefault(key, len(keys)), values.setdefault(coded, len(values))]
        geometry = [1 << 3 | 1, zigzag(x), zigzag(y)]  # one MoveTo
        features += field(2, field(2, b"".join(map(varint, tags))) + varint(3 << 3) + varint(1) + field(4, b"".join(map(varint, geometry))))
    body = varint(15 << 3) + varint(2) + field(1, name.encode()) + features
    body += b"".join(field(3, k.encode()) for k in keys) + b"".join(field(4, v) for v in values)
    return field(3, body + varint(5 << 3) + varint(EXTENT))


def decoded_points(tile: bytes) -> list[tuple[int, int]]:
    """Places of the points of a tile of one layer; to check what was written."""

    def fields(data: bytes) -> Iterator[tuple[int, object]]:
        at = 0
        while at < len(data):
            tag, at = number(data, at)
            if tag & 7 == 2:
                size, at = number(data, at)
                yield tag >> 3, data[at : at + size]
                at += size
            elif tag & 7 == 1:
                yield tag >> 3, data[at : at + 8]
                at += 8
            else:
                value, at = number(data, at)
                yield tag >> 3, value

    def number(data: bytes, at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, at

    out = []
    for _, body in fields(tile):
        for number_, feature in fields(body):
            if number_ == 2:
                geometry = next(v for k, v in fields(feature) if k == 4)
                _, at = number(geometry, 0)
                x, at = number(geometry, at)
                y, at = number(geometry, at)
                out.append(tuple(n >> 1 if n % 2 == 0 else -(n + 1 >> 1) for n in (x, y)))
    return out


def encoded_tiles(points: DataFrame, tiles: DataFrame, zoom: int, name: str = "parking", limit: int = 500) -> DataFrame:
    """z, x, y, n_features, mvt of each asked tile that has features.

    The features of a tile come to one task in order and are written as they come, so that none is gathered before.
    """
    from curbside.operators.line_tiles import POINT, written

    placed = pixels(tile_features(points, tiles, zoom, limit), zoom, EXTENT)
    rows = placed.select("x", "y", "px", "py", "n", F.col("amount").cast("double").alias("amount")).repartition("x", "y").sortWithinPartitions("x", "y", "px", "py", "n", "amount")

    def features(frame: pd.DataFrame) -> Iterator[tuple]:
        for x, y, px, py, n, amount in zip(*[frame[c].tolist() for c in ("x", "y", "px", "py", "n", "amount")], strict=True):
            geometry = b"".join(map(varint, (1 << 3 | 1, zigzag(px), zigzag(py))))  # one MoveTo
            yield (x, y), (name, POINT, geometry, {"count": n} if amount is None or amount != amount else {"count": n, "amount": amount})

    return rows.mapInPandas(written(zoom, features), "z int, x long, y long, n_features int, mvt binary")
