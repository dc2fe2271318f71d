"""Lines and polygons in vector tiles: what is read back is what clipping and thinning should leave."""

import math
import random

import pytest

from curbside.operators import line_tiles as lt

FEATURES = "layer string, kind int, id long, n long, parts array<array<struct<lon: double, lat: double>>>"


def plain_thinned(points, least, fewest):
    """The same rule, looking for the least area anew each time."""
    points, floor = list(enumerate(points)), 0.0
    held = {}
    while len(points) > fewest:
        areas = []
        for k in range(1, len(points) - 1):
            (_, (x1, y1)), (at, (x2, y2)), (_, (x3, y3)) = points[k - 1 : k + 2]
            areas.append((max(held.get(at, 0.0), abs((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) / 2), at, k))
        if not areas:
            break
        floor, at, k = min(areas)
        if floor >= least:
            break
        for n in (k - 1, k + 1):
            held[points[n][0]] = max(held.get(points[n][0], 0.0), floor)
            own = [a for a, i, _ in areas if i == points[n][0]]
            held[points[n][0]] = floor if own else 0.0
        del points[k]
    return [p for _, p in points]


@pytest.mark.parametrize("seed", range(4))
def test_thinning_equals_a_plain_version(seed):
    rng = random.Random(seed)
    x = 0.0
    points = [((x := x + rng.uniform(0.1, 3)), rng.uniform(-4, 4)) for _ in range(60)]
    for least in (0.3, 2.0, 9.0):
        got = lt.thinned(points, least)
        assert got == plain_thinned(points, least, 2)
        assert got[0] == points[0] and got[-1] == points[-1] and len(got) < len(points)
    assert lt.thinned(points, 0) == points and len(lt.thinned(points, 1e9, 4)) == 4


def test_tolerances_follow_the_zoom():
    width = lambda z: 2 * lt.HALF_WORLD / 2**z
    assert [lt.tolerance(z) for z in (9, 10, 13, 15, 16)] == [width(9) / 6, width(10) / 12, width(13) / 24, width(15) / 48, 0.0]


def covered(parts, px, py):
    odd = False
    for ring in parts:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def test_polygons_read_back_equal_the_clipped_input(spark):
    rng = random.Random(1)
    outer = [(-79.4 + 0.2 * rng.uniform(0.6, 1) * math.cos(2 * math.pi * k / 24), 43.7 + 0.2 * rng.uniform(0.6, 1) * math.sin(2 * math.pi * k / 24)) for k in range(24)]
    hole = [(-79.42, 43.68), (-79.42, 43.72), (-79.38, 43.72), (-79.38, 43.68), (-79.42, 43.68)]
    rows = spark.createDataFrame([("wards", lt.POLYGON, 7, 3, [outer, hole]), ("lines", lt.LINE, 1, 2, [[(-79.6, 43.7), (-79.2, 43.7)]])], FEATURES)
    tiles = lt.shape_tiles(rows, 11).collect()
    assert len(tiles) > 4
    seen = 0
    for tile in tiles:
        features = lt.read_tile(bytes(tile.mvt))
        assert [f["layer"] for f in features] == sorted(f["layer"] for f in features) and len(features) == tile.n_features
        size = 2 * lt.HALF_WORLD / 2**11
        for f in features:
            assert all(-64 <= v <= lt.EXTENT + 64 for part in f["parts"] for p in part for v in p)
            if f["kind"] == lt.LINE:
                continue
            assert (f["id"], f["count"]) == (7, 3)
            areas = [lt.ring_area(r) for r in f["parts"]]
            assert areas[0] > 0 and all(a < 0 for a in areas[1:])
            place = lambda p: [(x - (tile.x * size - lt.HALF_WORLD)) / size * lt.EXTENT for x in [lt.mercator(*p)[0]]] + [((lt.HALF_WORLD - tile.y * size) - lt.mercator(*p)[1]) / size * lt.EXTENT]
            whole = [[tuple(place(p)) for p in ring] for ring in (outer, hole[:-1])]
            wrong = 0
            for _ in range(400):
                px, py = rng.uniform(-60, lt.EXTENT + 60), rng.uniform(-60, lt.EXTENT + 60)
                wrong += covered(whole, px, py) != covered(f["parts"], px, py)
                seen += covered(whole, px, py)
            assert wrong <= 4  # places within a pixel of a border
    assert seen > 500


def test_lines_are_in_every_tile_that_they_cross(spark):
    """Compared with fine steps along each line; an order of parts and features within the tile by id."""
    rng = random.Random(2)
    rows = [("glow", lt.LINE, k, k % 5, [[(-79.5 + rng.uniform(0, 0.2), 43.6 + rng.uniform(0, 0.2)) for _ in range(4)]]) for k in range(30)]
    tiles = {(t.x, t.y): lt.read_tile(bytes(t.mvt)) for t in lt.shape_tiles(spark.createDataFrame(rows, FEATURES), 13, 32).collect()}
    size, crossed = 2 * lt.HALF_WORLD / 2**13, set()
    for _, _, k, _, parts in rows:
        corners = [lt.mercator(*p) for p in parts[0]]
        for (x1, y1), (x2, y2) in zip(corners, corners[1:], strict=False):
            for step in range(2001):
                x, y = x1 + (x2 - x1) * step / 2000, y1 + (y2 - y1) * step / 2000
                crossed.add((math.floor((x + lt.HALF_WORLD) / size), math.floor((lt.HALF_WORLD - y) / size), k))
    found = {(x, y, f["id"]) for (x, y), features in tiles.items() for f in features}
    assert crossed <= found and len(found) < 2 * len(crossed)
    assert all([f["id"] for f in features] == sorted(f["id"] for f in features) for features in tiles.values())
    asked = spark.createDataFrame([(x, y) for x, y, _ in sorted(crossed)[:1]], "x long, y long")
    only = lt.shape_tiles(spark.createDataFrame(rows, FEATURES), 13, 32, asked=asked).collect()
    assert len(only) == 1 and lt.read_tile(bytes(only[0].mvt)) == tiles[only[0].x, only[0].y]


def test_points_are_written_as_they_come():
    """The same bytes as a layer made of all its points at once, from rows in two frames; a tile ends where the next one begins."""
    import pandas as pd

    from curbside.operators.vector_tiles import layer, varint, zigzag

    rows = [((0, 0), 5, 6, 2, 1.5), ((0, 0), 7, 8, 1, None), ((0, 1), 9, 9, 4, 2.0), ((0, 1), 10, 9, 4, 2.0)]

    def features(frame):
        for place, px, py, n, amount in frame["row"]:
            yield place, ("parking", lt.POINT, b"".join(map(varint, (9, zigzag(px), zigzag(py)))), {"count": n} if amount is None else {"count": n, "amount": amount})

    tiles = list(lt.written(14, features)(iter([pd.DataFrame({"row": rows[:3]}), pd.DataFrame({"row": rows[3:]})])))
    want = [layer("parking", [(px, py, {"count": n, "amount": amount}) for place, px, py, n, amount in rows if place == at]) for at in ((0, 0), (0, 1))]
    assert [t["mvt"].iloc[0] for t in tiles] == want and [int(t["n_features"].iloc[0]) for t in tiles] == [2, 2]
