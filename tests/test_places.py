"""Streets, numbers, names and shapes against plain versions that look at everything."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from curbside.functions import shapes
from curbside.operators import geocode, joins
from curbside.operators.polygons import cover, in_polygons

SEGMENTS = "street_key string, segment_id int, parity int, low int, high int"


def random_network(rng, n):
    rows = []
    for k in range(n):
        low = rng.choice([0, 1, rng.randrange(900), rng.randrange(60)])
        rows.append((rng.choice("ABC"), k, rng.randrange(2), low, low + rng.choice([0, 1, 2, 40, 300, -1])))
    return rows


def plain_match(segments, street, number):
    own = [s for s in segments if s[0] == street and s[3] <= s[4]]
    held = [(s[4] - s[3], s[1]) for s in own if s[2] == number % 2 and s[3] <= number <= s[4]]
    if held:
        return min(held)[1], True, 0
    near = [(0 if s[3] <= number <= s[4] else min(abs(number - s[3]), abs(number - s[4])), s[1]) for s in own]
    return (min(near)[1], False, min(near)[0]) if near else None


def test_range_match_equals_a_look_at_all_segments(spark):
    rng = random.Random(4)
    segments = random_network(rng, 120)
    facts = [(k, rng.choice("ABCD"), rng.choice([rng.randrange(1300), rng.randrange(70), -3, 10**6])) for k in range(500)] + [(900, "A", None)]
    found = joins.range_matched(spark.createDataFrame(facts, "id int, street_key string, number int"), spark.createDataFrame(segments, SEGMENTS), "id", "number")
    got = {r.id: (r.segment_id, r.inside, r.off) for r in found.collect()}
    want = {k: plain_match(segments, street, n) for k, street, n in facts if n is not None}
    assert got == {k: v for k, v in want.items() if v}


def test_range_match_joins_few_rows(spark):
    """Rows that meet grow with numbers and segments, not with their product."""
    n = 4000
    segments = spark.range(n).selectExpr("'A' AS street_key", "CAST(id AS INT) AS segment_id", "CAST(id % 2 AS INT) AS parity", "CAST(id * 2 AS INT) AS low", "CAST(id * 2 + 3000 AS INT) AS high")
    facts = spark.range(n).selectExpr("id", "'A' AS street_key", "CAST(id * 3 AS INT) AS number")
    found = joins.range_matched(facts, segments, "id", "number")
    found.write.format("noop").mode("overwrite").save()
    plan = found._jdf.queryExecution().executedPlan()
    assert "Cartesian" not in plan.toString() and "NestedLoop" not in plan.toString()
    sizes = []

    def walk(node):
        name = node.nodeName()
        if "Join" in name and node.metrics().contains("numOutputRows"):
            sizes.append(node.metrics().apply("numOutputRows").value())
        if name.startswith("AdaptiveSparkPlan"):
            walk(node.executedPlan())
        elif "QueryStage" in name:
            walk(node.plan())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(plan)
    assert found.count() == n and sizes and max(sizes) < 64 * n


def plain_nearest(typed, known, least=0.82):
    out = {}
    for t in {t for t in typed if t}:
        rated = [(difflib.SequenceMatcher(None, k, t).ratio(), k) for k in set(known)]
        best = max(rated)
        if best[0] >= least:
            out[t] = best[1]
    return out


def test_nearest_names_equal_all_pairs(spark):
    rng = random.Random(8)
    parts = ["QUEEN", "KING", "YONGE", "BAY", "ELM", "OAK", "SPADINA", "DUNDAS", "ST CLAIR", "X", "MOUNT PLEASANT"]
    known = sorted({f"{rng.choice(parts)}{rng.choice(['', ' ' + rng.choice(parts)])} {rng.choice(['STREET', 'ROAD', 'AVENUE EAST'])}" for _ in range(150)} | {"A", "AB", "ABC"})

    def spoilt(name):
        letters = list(name)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(letters))
            letters[k : k + 1] = rng.choice([[], [rng.choice("ABCXYZ ")], [letters[k], letters[k]]])
            letters = letters or ["Q"]
        return "".join(letters)

    typed = [spoilt(rng.choice(known)) for _ in range(250)] + ["", None, "NOTHING LIKE IT", "AB"]
    found = joins.nearest_names(spark.createDataFrame([(t,) for t in typed], "typed string"), spark.createDataFrame([(k,) for k in known], "known string"))
    assert {r.typed: r.known for r in found.collect()} == plain_nearest(typed, known)


def test_many_names_meet_in_few_pairs(spark):
    """Of 2,000 names that all end alike every one finds its own spelling; what they share brings few together."""
    rng = random.Random(9)
    known = sorted({"".join(rng.choice("ABCDEFGHIJKLMNOPRSTUVW") for _ in range(9)) + " STREET" for _ in range(2_000)})
    typed = {k[:4] + "Z" + k[4:]: k for k in known[::10]}
    rows = spark.createDataFrame([(t,) for t in typed], "typed string")
    found = joins.nearest_names(rows, spark.createDataFrame([(k,) for k in known], "known string"))
    assert {r.typed: r.known for r in found.collect()} == typed


def test_misspelt_streets_are_placed(spark):
    network = spark.createDataFrame([(1, "YONGE STREET", 0, 2, 100, -79.38, 43.66), (2, "YONGE STREET", 0, 102, 200, -79.38, 43.67), (3, "BLOOR ST W", 0, 2, 400, -79.39, 43.67)], "segment_id int, street_key string, parity int, low int, high int, lon double, lat double")
    asked = ["7 Yonge St", "150 YONGGE ST", "150B YONGE ST", "YONGE ST N/O BLOOR ST W", "Bloor St W", "Bloor 7", "12 34 YONGE ST", None, ""]
    found = geocode.geocoded(spark.createDataFrame([(a,) for a in asked], "address string"), network).collect()
    assert {r.address: (r.method, r.segment_id) for r in found} == {
        "7 Yonge St": ("nearest_range", 1), "150 YONGGE ST": ("range", 2), "150B YONGE ST": ("range", 2), "YONGE ST N/O BLOOR ST W": ("intersection", 2), "Bloor St W": ("street", 3), "12 34 YONGE ST": ("range", 1),
    }


def plain_nearest_pairs(a, b):
    import math

    best = {}
    for key, p, lon, lat in a:
        for _, q, lon2, lat2 in (r for r in b if r[0] == key):
            metres = round(math.hypot((lat - lat2) * 111_320.0, (lon - lon2) * 78_850.0), 6)
            best[key] = min(best.get(key, (math.inf,)), (metres, p, q))
    return {key: (p, q) for key, (_, p, q) in best.items()}


def test_nearest_pairs_equal_all_pairs(spark):
    """Shapes that cells tell apart late or never: separate crowds, parallel lines, a lattice of equal distances, a ring around a crowd."""
    import math

    rng = random.Random(4)
    crowd = lambda x, y, size, n: [(x + rng.uniform(0, size), y + rng.uniform(0, size)) for _ in range(n)]
    shapes = {
        "crowds": (crowd(-79.5, 43.6, 0.01, 80), crowd(-79.4, 43.7, 0.01, 80)),
        "mixed": (crowd(-79.5, 43.6, 0.2, 80), crowd(-79.5, 43.6, 0.2, 80)),
        "lines": ([(-79.5 + k / 1000, 43.6) for k in range(80)], [(-79.5 + k / 1000, 43.61) for k in range(80)]),
        "lattice": ([(-79.5 + k / 1000, 43.6 + j / 1000) for k in range(9) for j in range(9) if (k + j) % 2], [(-79.5 + k / 1000, 43.6 + j / 1000) for k in range(9) for j in range(9) if (k + j) % 2 == 0]),
        "ring": ([(-79.5 + math.cos(k / 12) / 788.5, 43.6 + math.sin(k / 12) / 1113.2) for k in range(75)], crowd(-79.5, 43.6, 0.00001, 60)),
        "same places": ([(-79.5, 43.6)] * 20 + [(-79.4, 43.6)] * 20, [(-79.4, 43.6)] * 30 + [(-79.5, 43.6)] * 30),
        "outlier": ([(0.0, 0.0), *crowd(-79.5, 43.6, 0.00001, 40)], [(120.0, -30.0), *crowd(-79.50002, 43.6, 0.00001, 40)]),
        "one": ([(-79.5, 43.6)], crowd(-79.6, 43.5, 0.2, 90)),
    }
    ids = iter(rng.sample(range(10_000), 2_000))
    a, b = ([(key, next(ids), *p) for key, both in shapes.items() for p in both[k]] for k in (0, 1))
    a.append(("alone", -1, -79.5, 43.6))
    odd = [("no place", 5, None, 43.6), ("no place", 3, float("nan"), 43.6), ("crowds", -9, None, None)], [("no place", 6, -79.5, 43.6), ("no place", 7, -79.4, 43.6)]
    schema = "key string, segment_id int, lon double, lat double"
    sides = [spark.createDataFrame(rows + more, schema) for rows, more in zip((a, b), odd, strict=True)]
    wanted = plain_nearest_pairs(a, b) | {"no place": (3, 6)}
    for at_once in (0, 20_000, 1_000_000):
        found = joins.nearest_pairs(*sides, "key", at_once).collect()
        assert {r.key: (r.id_a, r.id_b) for r in found} == wanted and len(found) == len(wanted)
    half = next(r for r in found if r.key == "lines")
    assert (half.lat, half.metres) == (pytest.approx(43.605), pytest.approx(1113.2))


def star(rng, x, y, size, corners):
    import math

    return [(x + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / corners), y + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / corners)) for k in range(corners)]


def plain_inside(lon, lat, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


RINGS = "position int, polygon string, rings array<array<struct<lon: double, lat: double>>>"


@pytest.mark.parametrize("depth", [0, 5])
def test_polygons_with_holes_and_parts(spark, depth):
    rng = random.Random(3)
    rows = []
    for k in range(7):
        x, y = rng.uniform(-0.5, 0.5), rng.uniform(-0.5, 0.5)
        rings = [star(rng, x, y, 0.4, 40), [(x - 0.05, y - 0.05), (x + 0.05, y - 0.05), (x + 0.05, y + 0.05), (x - 0.05, y + 0.05)], star(rng, x + 1, y, 0.1, 5)]
        rows.append((k, f"p{k}", rings))
    points = [(k, rng.uniform(-1.1, 1.8), rng.uniform(-1.1, 1.1)) for k in range(1500)] + [(9000, None, 0.0)]
    shapes_ = spark.createDataFrame(rows, RINGS)
    found = in_polygons(spark.createDataFrame(points, "id int, lon double, lat double"), shapes_, 0.16, depth)
    want = {i: None if x is None else next((name for _, name, rings in rows if plain_inside(x, y, rings)), None) for i, x, y in points}
    assert {r.id: r.polygon for r in found.collect()} == want
    assert len({v for v in want.values()}) > 5
    if depth:  # nearly all cells are full, and those on a border hold a few of the edges
        cells = cover(shapes_, 0.16, depth).select(F.explode("shapes").alias("s")).select("s.full", F.size("s.edges").alias("n")).collect()
        assert max(c.n for c in cells) < 45 and sum(c.full for c in cells) > 200


def test_polygon_ties_go_to_the_first(spark):
    box = lambda w, s, e, n: [[(w, s), (e, s), (e, n), (w, n), (w, s)]]
    polygons = spark.createDataFrame([(0, "first", box(0.0, 0.0, 0.02, 0.02)), (1, "second", box(0.01, 0.0, 0.03, 0.02))], RINGS)
    points = spark.createDataFrame([(1, 0.015, 0.01), (2, 0.025, 0.01), (3, 0.5, 0.5)], "id int, lon double, lat double")
    assert {r["id"]: r["polygon"] for r in in_polygons(points, polygons).collect()} == {1: "first", 2: "second", 3: None}


def test_clipped_shapes_keep_their_points(spark):
    """A point within the rectangle is in the clipped shape if it was in the whole one; areas agree with a count of points."""
    rng = random.Random(5)
    rings = [star(rng, 0, 0, 1, 30), [(-0.1, -0.1), (-0.1, 0.1), (0.1, 0.1), (0.1, -0.1)]]
    rows = spark.createDataFrame([(0, "p", rings), (1, "gone", [[(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)]])], RINGS)
    cut = shapes.clipped(rows, "rings", -0.4, -0.5, 0.55, 0.05).withColumn("area", shapes.area(F.col("rings"))).orderBy("position").collect()
    kept = [[(p.lon, p.lat) for p in ring] for ring in cut[0].rings]
    assert cut[1].rings == [] and all(-0.4 <= x <= 0.55 and -0.5 <= y <= 0.05 for ring in kept for x, y in ring)
    tried = [(rng.uniform(-0.4, 0.55), rng.uniform(-0.5, 0.05)) for _ in range(20_000)]
    inside = [plain_inside(x, y, kept) for x, y in tried]
    assert inside == [plain_inside(x, y, rings) for x, y in tried]
    assert cut[0].area == pytest.approx(0.95 * 0.55 * sum(inside) / len(inside), rel=0.03)
