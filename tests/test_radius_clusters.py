"""Clusters within a radius against a plain version of the same rule."""

import math
import random

from curbside.operators import radius_clusters as rc


def plain(points, ranks, radius):
    left, centres = dict(points), {}
    cell = lambda p: (math.floor(p[0] / (radius / math.sqrt(2))), math.floor(p[1] / (radius / math.sqrt(2))))
    near = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= radius * radius
    while left:
        offers = {}
        for k, p in left.items():
            if cell(p) not in offers or (ranks[k], k) < (ranks[offers[cell(p)]], offers[cell(p)]):
                offers[cell(p)] = k
        own = list(offers.values())
        chosen = [k for k in own if not any((ranks[j], j) < (ranks[k], k) and near(left[j], left[k]) for j in own)]
        centres |= {k: left[k] for k in chosen}
        left = {k: p for k, p in left.items() if not any(near(p, centres[c]) for c in chosen)}
    return centres


def test_clusters_equal_a_plain_version(spark):
    rng = random.Random(3)
    points = [(k, rng.gauss(0, 30) + 100 * (k % 3), rng.gauss(0, 30)) for k in range(300)] + [(900, 0.0, 0.0), (901, 0.0, 0.0)]
    radius = 25.0
    rows = spark.createDataFrame([(k, x, y, k % 4 + 1, float(k)) for k, x, y in points], "key long, x double, y double, n long, amount double")
    ranks = {r.key: r.rank for r in rows.selectExpr("key", "xxhash64(key) AS rank").collect()}
    places = {k: (x, y) for k, x, y in points}
    want = plain(places, ranks, radius)
    got = {r.key: (r.x, r.y) for r in rc.centres(rows, radius).collect()}
    assert got == want and 5 < len(got) < 100
    for k, p in got.items():
        assert all(j == k or math.dist(p, q) > radius for j, q in got.items())
    clusters = {r.key: r for r in rc.clustered(rows, radius).collect()}
    assert clusters.keys() == got.keys()
    assert sum(c.n for c in clusters.values()) == sum(k % 4 + 1 for k, _, _ in points)
    assert sum(c.amount for c in clusters.values()) == sum(float(k) for k, _, _ in points)
    owner = {k: min((ranks[c], c) for c, q in got.items() if math.dist(p, q) <= radius)[1] for k, p in places.items()}
    one = next(iter(got))
    own = [k for k in places if owner[k] == one]
    assert math.isclose(clusters[one].x, sum(places[k][0] * (k % 4 + 1) for k in own) / sum(k % 4 + 1 for k in own))


def test_zoom_by_zoom(spark):
    rows = spark.range(200).selectExpr("id AS key", "CAST(id % 20 AS DOUBLE) AS x", "CAST(id DIV 20 AS DOUBLE) AS y", "1L AS n", "1.0D AS amount")
    found = rc.zoomed(rows, [1, 2], 8.0).collect()
    sizes = {z: [r for r in found if r.zoom == z] for z in (1, 2)}
    assert sum(r.n for r in sizes[1]) == sum(r.n for r in sizes[2]) == 200 and len(sizes[1]) < len(sizes[2])
    assert {r.key for r in sizes[1]} <= {r.key for r in sizes[2]}
