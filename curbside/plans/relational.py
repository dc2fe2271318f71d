"""Registered filters, joins, sets, sorts and writers (SRC, SNK, FLT, JOI, SET, TOP)."""

from __future__ import annotations

from pyspark.sql import functions as F

from curbside.functions.shapes import area, clipped
from curbside.operators import joins
from curbside.operators.aggregates import totals
from curbside.operators.polygons import in_polygons
from curbside.operators.windows import top_per_group
from curbside.plans.registry import query
from curbside.sources.tables import ADDRESSES_SQL, LINE_TICKETS_SQL, POINTS_SQL, SITES_SQL, TAGS_SQL, TICKETS_SQL, addresses, line_tickets, points, sites, table, tags, tickets

LT, TK, ST, PT, TG = (f"WITH {x} " for x in (LINE_TICKETS_SQL, TICKETS_SQL, SITES_SQL, POINTS_SQL, TAGS_SQL))


# Filters.
@query("FLT01_required_fields", LT + "SELECT ticket_number FROM line_tickets WHERE month <> 13 AND order_key % 7 <> 0")
def required_fields(s, d):
    from curbside.functions.dates import parsed_date

    raw = line_tickets(s, d).select(F.when(F.col("order_key") % 7 != 0, F.col("ticket_number")).alias("ticket_number"), F.date_format("ticket_date", "yyyyMMdd").alias("day"))
    return raw.filter(F.col("ticket_number").isNotNull() & parsed_date(F.col("day")).isNotNull()).select("ticket_number")


@query("FLT02_usable_location", f"WITH {ADDRESSES_SQL} SELECT id FROM addresses WHERE address IS NOT NULL AND trim(address) <> '' AND lower(trim(address)) <> 'nan'")
def usable_location(s, d):
    c = F.col("address")
    return addresses(s, d).filter(c.isNotNull() & (F.trim(c) != "") & (F.lower(F.trim(c)) != "nan")).select("id")


def _filtered(df, year=None, month=None):
    """A filter that is not asked for is not in the plan."""
    for name, value in (("year", year), ("month", month)):
        df = df if value is None else df.filter(F.col(name) == value)
    return df


@query("FLT03_optional_year", LT + "SELECT count(*) AS n FROM line_tickets")
def optional_year(s, d):
    return _filtered(line_tickets(s, d)).agg(F.count("*").alias("n"))


@query("FLT04_year_and_month", LT + "SELECT count(*) AS n, sum(fine) AS fines FROM line_tickets WHERE year = 1996 AND month = 3")
def year_and_month(s, d):
    return _filtered(line_tickets(s, d), 1996, 3).agg(F.count("*").alias("n"), F.sum("fine").alias("fines"))


@query("FLT05_year_pushed_down", "SELECT count(*) AS n FROM lineitem WHERE year(l_shipdate) = 1997")
def year_pushed_down(s, d):
    """A year as a range of the stored column, so that it reaches the scan."""
    ship = F.col("l_shipdate")
    return table(s, d, "lineitem").filter((ship >= F.lit("1997-01-01").cast(dict(table(s, d, "lineitem").dtypes)["l_shipdate"])) & (ship < F.lit("1998-01-01").cast(dict(table(s, d, "lineitem").dtypes)["l_shipdate"]))).agg(F.count("*").alias("n"))


@query("FLT06_years_contain", LT + "SELECT site_key FROM (SELECT site_key, list(DISTINCT year) AS ys FROM line_tickets GROUP BY site_key) WHERE list_contains(ys, 1998)")
def years_contain(s, d):
    years = line_tickets(s, d).groupBy("site_key").agg(F.collect_set("year").alias("ys"))
    return years.filter(F.array_contains(F.coalesce("ys", F.array().cast("array<int>")), 1998)).select("site_key")


@query("FLT07_mask_contains", LT + "SELECT DISTINCT site_key FROM line_tickets WHERE year = 1995")
def mask_contains(s, d):
    from curbside.functions.values import mask_has
    from curbside.operators.aggregates import masks

    return masks(line_tickets(s, d), ["site_key"], 1990).filter(mask_has(F.col("years_mask"), 1995, 1990)).select("site_key")


@query("FLT08_text_or_code", "SELECT p_partkey FROM part WHERE p_name ILIKE '%RING%' OR p_brand = 'Brand#7'")
def text_or_code(s, d):
    return table(s, d, "part").filter(F.col("p_name").ilike("%RING%") | (F.col("p_brand") == "Brand#7")).select("p_partkey")


@query("FLT09_any_column", "SELECT p_partkey FROM part WHERE p_name ILIKE '%red%' OR p_type ILIKE '%eco%' OR p_partkey = 42")
def any_column(s, d):
    return table(s, d, "part").filter(F.col("p_name").ilike("%red%") | F.col("p_type").ilike("%eco%") | (F.col("p_partkey") == 42)).select("p_partkey")


@query("FLT10_suggestions", "SELECT DISTINCT p_name AS name, CASE WHEN lower(p_name) LIKE 're%' THEN 0 ELSE 1 END AS rank FROM part WHERE lower(p_name) LIKE '%re%' ORDER BY rank, name LIMIT 12")
def suggestions(s, d, typed="re", limit=12):
    if len(typed) < 2:
        return table(s, d, "part").select(F.col("p_name").alias("name"), F.lit(0).alias("rank")).limit(0)
    name = F.lower("p_name")
    rank = F.when(name.startswith(typed), 0).when(name.contains(typed), 1)
    return table(s, d, "part").select(F.col("p_name").alias("name"), rank.alias("rank")).filter("rank IS NOT NULL").distinct().orderBy("rank", "name").limit(limit)


@query("FLT11_without_junk", "SELECT doc_id FROM documents WHERE text NOT LIKE '%$%' AND text NOT LIKE '%*%'")
def without_junk(s, d):
    return table(s, d, "documents").filter(~F.col("text").contains("$") & ~F.col("text").contains("*")).select("doc_id")


@query("FLT12_guarded_cast", "SELECT o_orderkey, CASE WHEN regexp_full_match(t, '[0-9]{4}') THEN CAST(t AS INT) END AS v FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN lpad(concat(o_orderkey % 2400), 4, '0') ELSE 'x' END AS t FROM orders)")
def guarded_cast(s, d):
    k = F.col("o_orderkey")
    t = F.when(k % 2 == 0, F.lpad((k % 2400).cast("string"), 4, "0")).otherwise("x")
    return table(s, d, "orders").select("o_orderkey", F.when(t.rlike("^[0-9]{4}$"), t.try_cast("int")).alias("v"))


@query("FLT13_in_top", LT + "SELECT count(*) AS n FROM line_tickets WHERE site_key IN (SELECT site_key FROM line_tickets GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)")
def in_top(s, d):
    t = line_tickets(s, d)
    top = t.groupBy("site_key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "site_key").limit(3)
    return t.join(F.broadcast(top.select("site_key")), "site_key", "left_semi").agg(F.count("*").alias("n"))


@query("FLT14_like_any", "SELECT p_partkey FROM part WHERE p_type LIKE '%ECO%' OR p_type LIKE 'PRO%' OR p_type LIKE '%ARD'")
def like_any(s, d):
    t = F.col("p_type")
    return table(s, d, "part").filter(t.like("%ECO%") | t.like("PRO%") | t.like("%ARD")).select("p_partkey")


@query("FLT15_text_since", "SELECT o_orderkey FROM orders WHERE o_orderpriority ILIKE '%urgent%' AND CAST(o_orderdate AS DATE) >= DATE '1997-06-01'")
def text_since(s, d):
    return table(s, d, "orders").filter(F.col("o_orderpriority").ilike("%urgent%") & (F.to_date("o_orderdate") >= F.lit("1997-06-01").cast("date"))).select("o_orderkey")


@query("FLT16_zoom_range", "SELECT p_partkey FROM part WHERE p_size % 10 <= 6 AND 6 <= p_size % 10 + 5")
def zoom_range(s, d, zoom=6):
    return table(s, d, "part").filter(F.lit(zoom).between(F.col("p_size") % 10, F.col("p_size") % 10 + 5)).select("p_partkey")


@query("FLT17_bounding_box", PT + "SELECT point_key FROM points WHERE lon BETWEEN -79.5 AND -79.3 AND lat BETWEEN 43.6 AND 43.7")
def bounding_box(s, d):
    return points(s, d).filter(F.col("lon").between(-79.5, -79.3) & F.col("lat").between(43.6, 43.7)).select("point_key")


@query(
    "FLT18_quadkey_prefix",
    PT + """, q AS (SELECT point_key, array_to_string(list_transform(range(13, -1, -1), lambda k: (CAST(floor((lon + 180) / 360 * 16384) AS BIGINT) >> k) % 2 + 2 * ((CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384) AS BIGINT) >> k) % 2)), '') AS q FROM points)
    SELECT point_key, q FROM q WHERE q LIKE '03022310%'""",
)
def quadkey_prefix(s, d, prefix="03022310"):
    from curbside.operators.tiles import tiled

    rows = tiled(points(s, d), 14)
    return rows.filter((F.col("tile_group") == prefix[0]) & F.col("quadkey").startswith(prefix)).select("point_key", F.col("quadkey").alias("q"))


@query("FLT19_own_predicate", LT + "SELECT count(*) AS n FROM line_tickets WHERE code = 'R' AND fine > 30000")
def own_predicate(s, d, keep=("R", 30000)):
    return line_tickets(s, d).filter((F.col("code") == F.lit(keep[0])) & (F.col("fine") > keep[1])).agg(F.count("*").alias("n"))


@query("FLT20_required_texts", f"WITH {ADDRESSES_SQL} SELECT id FROM addresses WHERE trim(address) <> ''")
def required_texts(s, d, columns=("address",)):
    df = addresses(s, d)
    for c in columns:
        df = df.filter(F.trim(c) != "")
    return df.select("id")


@query("FLT21_split_by_month", LT + "SELECT CASE WHEN month IN (3, 10, 11, 12) THEN 'eval' ELSE 'train' END AS split, count(*) AS n FROM line_tickets GROUP BY 1")
def split_by_month(s, d):
    from curbside.operators.corpus import split_of

    return line_tickets(s, d).groupBy(split_of(F.col("month")).alias("split")).agg(F.count("*").alias("n"))


@query("FLT22_with_number", "SELECT count(*) AS n FROM events WHERE event_id % 9 <> 0")
def with_number(s, d):
    return table(s, d, "events").select(F.when(F.col("event_id") % 9 != 0, F.col("event_id")).alias("number")).dropna(subset=["number"]).agg(F.count("*").alias("n"))


@query("FLT23_bursts", TG + "SELECT tag FROM (SELECT tag, epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY tag)) AS us FROM tags) WHERE us <= 300000000")
def bursts(s, d):
    from curbside.operators.patterns import minutes_since_previous

    return minutes_since_previous(tags(s, d)).filter("minutes_since <= 5.0").select("tag")


@query("FLT24_large_gaps", TG + "SELECT tag, number - p AS gap FROM (SELECT tag, number, lag(number) OVER (ORDER BY tag) AS p FROM tags) WHERE number - p > 7")
def large_gaps(s, d):
    from curbside.operators.patterns import differences

    return differences(tags(s, d), 1).filter("diff1 > 7").select("tag", F.col("diff1").alias("gap"))


# Joins.
@query("JOI01_left_lookup", "SELECT c_custkey, coalesce(n_name, 'Unknown') AS area FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def left_lookup(s, d):
    areas = table(s, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("area"))
    return joins.enriched(table(s, d, "customer").select("c_custkey", "c_nationkey"), areas, "c_nationkey", {"area": "Unknown"}).select("c_custkey", "area")


@query("JOI02_match_reasons", "SELECT CASE WHEN c_nationkey % 5 = 0 THEN 'no_key' WHEN c_nationkey >= 20 THEN 'no_match' ELSE 'matched' END AS outcome, count(*) AS n FROM customer GROUP BY 1")
def match_reasons(s, d):
    facts = table(s, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey")).alias("k"))
    areas = table(s, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("area"))
    return joins.matched_with_reasons(facts, areas, "k", "area")[1]


_TOP_SQL = TK + """, m AS (SELECT year, location, count(*) AS ticket_count, CAST(coalesce(sum(fine), 0) AS DECIMAL(28,2)) AS total_revenue FROM tickets GROUP BY ALL),
  r AS (SELECT year, location, brand, row_number() OVER (PARTITION BY year, location ORDER BY count(*) DESC, brand) AS rn FROM tickets GROUP BY year, location, brand)
  SELECT m.year, m.location, ticket_count, total_revenue, brand AS top_brand FROM m LEFT JOIN r ON m.year = r.year AND m.location = r.location AND rn = 1"""


def _top_infraction(s, d):
    from curbside.operators.marts import location_years

    return location_years(tickets(s, d), "location", "brand").select("year", "location", "ticket_count", "total_revenue", "top_brand")


query("JOI03_totals_with_top", _TOP_SQL)(_top_infraction)
query("WIN01_top_infraction", _TOP_SQL)(_top_infraction)


@query("JOI04_left_using", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN (SELECT c_custkey AS o_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0) USING (o_custkey)")
def left_using(s, d):
    even = table(s, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(s, d, "orders").select("o_orderkey", "o_custkey").join(even, on="o_custkey", how="left").select("o_orderkey", "c_mktsegment")


_OUTER = """, a AS (SELECT year AS k, count(*) AS n FROM line_tickets WHERE code = 'A' AND year < 2000 GROUP BY 1), b AS (SELECT year AS k, count(*) AS n FROM line_tickets WHERE code = 'N' AND year > 1995 GROUP BY 1) """


def _halves(s, d):
    t = line_tickets(s, d)
    count = lambda f: t.filter(f).groupBy(F.col("year").alias("k")).agg(F.count("*").alias("n"))
    return count("code = 'A' AND year < 2000"), count("code = 'N' AND year > 1995")


@query("JOI05_full_outer", LT + _OUTER + "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS a_n, coalesce(b.n, 0) AS b_n FROM a FULL JOIN b ON a.k = b.k")
def full_outer(s, d):
    return joins.merged_outer(*_halves(s, d), "k", ["n"], ("a", "b"))


@query("JOI06_first_source_wins", LT + _OUTER + "SELECT k, n FROM a UNION ALL SELECT k, n FROM b WHERE k NOT IN (SELECT k FROM a)")
def first_source_wins(s, d):
    return joins.preferred(*_halves(s, d), "k")


@query("JOI07_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti(s, d):
    return table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("JOI08_not_in", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def not_in(s, d):
    table(s, d, "customer").createOrReplaceTempView("not_in_customer")
    table(s, d, "supplier").createOrReplaceTempView("not_in_supplier")
    return s.sql("SELECT c_custkey FROM not_in_customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM not_in_supplier WHERE s_acctbal > 5000)")


_HAV = "2 * 6371000.0 * asin(least(1.0, sqrt(sin(radians(s.lat - p.lat) / 2) ** 2 + cos(radians(p.lat)) * cos(radians(s.lat)) * sin(radians(s.lon - p.lon) / 2) ** 2)))"


@query("JOI09_within_distance", f"WITH {POINTS_SQL}, {SITES_SQL} SELECT point_key FROM points p WHERE EXISTS (SELECT 1 FROM sites s WHERE {_HAV} <= 500)")
def within_distance(s, d):
    return joins.within_distance(points(s, d), sites(s, d), 500.0).select("point_key")


@query("JOI10_cross_resolutions", "SELECT n_nationkey, g FROM nation CROSS JOIN (VALUES (250), (500), (1000)) r(g)")
def cross_resolutions(s, d):
    grids = s.createDataFrame([(250,), (500,), (1000,)], "g int")
    return table(s, d, "nation").select("n_nationkey").crossJoin(F.broadcast(grids))


@query("JOI11_lateral_variants", PT + "SELECT point_key, z, round(round(lon / g) * g, 6) AS lon FROM points, (VALUES (10, 0.01), (12, 0.001)) v(z, g)")
def lateral_variants(s, d):
    variants = F.array(*[F.struct(F.lit(z).alias("z"), F.round(F.round(F.col("lon") / g) * g, 6).alias("lon")) for z, g in ((10, 0.01), (12, 0.001))])
    return points(s, d).select("point_key", F.explode(variants).alias("v")).select("point_key", "v.*")


@query("JOI12_cached_when_wide", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN n_name END AS cached FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 25")
def cached_when_wide(s, d):
    p, n = table(s, d, "part").select("p_partkey", "p_size"), table(s, d, "nation").select("n_nationkey", "n_name")
    return p.join(joins.small(n), (F.col("n_nationkey") == F.col("p_partkey") % 25) & (F.col("p_size") <= 10), "left").select("p_partkey", F.col("n_name").alias("cached"))


def _box(x, y, w, h):
    """A closed ring around a rectangle, against the clock; with a negative width the other way round."""
    corner = lambda a, b: F.struct((x + a * w).alias("lon"), (y + b * h).alias("lat"))
    return F.array(*[corner(a, b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])


def _boxes(s):
    """Neighbourhoods that overlap, as shipped ones do; each has a hole, and every other one a second part within the hole."""
    rows = [(k, f"hood {k}", -79.6 + k * 0.05, 43.58 + (k % 3) * 0.07) for k in range(9)]
    df = s.createDataFrame(rows, "position int, polygon string, x double, y double")
    x, y = F.col("x"), F.col("y")
    hole = F.reverse(_box(x + 0.02, y + 0.03, F.lit(0.03), F.lit(0.05)))
    island = _box(x + 0.03, y + 0.05, F.lit(0.01), F.lit(0.02))
    rings = F.array(_box(x, y, F.lit(0.07), F.lit(0.12)), hole)
    return df.select("position", "polygon", F.when(F.col("position") % 2 == 0, F.concat(rings, F.array(island))).otherwise(rings).alias("rings"))


_HOODS = """, b AS (SELECT k, 'hood ' || k AS polygon, -79.6::DOUBLE + k * 0.05::DOUBLE AS x, 43.58::DOUBLE + (k % 3) * 0.07::DOUBLE AS y FROM range(9) r(k)),
    held AS (SELECT point_key, amount, k, polygon FROM points, b WHERE (lon >= x AND lon < x + 0.07::DOUBLE AND lat >= y AND lat < y + 0.12::DOUBLE)::INT
      + (lon >= x + 0.02::DOUBLE AND lon < x + 0.02::DOUBLE + 0.03::DOUBLE AND lat >= y + 0.03::DOUBLE AND lat < y + 0.03::DOUBLE + 0.05::DOUBLE)::INT
      + (k % 2 = 0 AND lon >= x + 0.03::DOUBLE AND lon < x + 0.03::DOUBLE + 0.01::DOUBLE AND lat >= y + 0.05::DOUBLE AND lat < y + 0.05::DOUBLE + 0.02::DOUBLE)::INT IN (1, 3)),
    first AS (SELECT point_key, arg_min(polygon, k) AS polygon FROM held GROUP BY 1) """


@query("JOI13_point_in_polygon", PT + _HOODS + "SELECT point_key, polygon FROM points LEFT JOIN first USING (point_key)")
def point_in_polygon(s, d):
    return in_polygons(points(s, d), _boxes(s)).select("point_key", "polygon")


@query("JOI14_tile_features", PT + "SELECT CAST(floor((lon + 180) / 360 * 2048) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 2048) AS BIGINT) AS y, count(*) AS n FROM points GROUP BY ALL")
def tile_features(s, d):
    """Tiles meet their features by the tile each point falls in."""
    from curbside.functions.geo import tile_x, tile_y

    placed = points(s, d).withColumns({"x": tile_x(F.col("lon"), 11), "y": tile_y(F.col("lat"), 11)})
    asked = placed.select("x", "y").distinct()
    return asked.join(placed, ["x", "y"]).groupBy("x", "y").agg(F.count("*").alias("n"))


_SEG = """, seg AS (SELECT p_type AS street_key, p_partkey AS segment_id, p_partkey % 2 AS parity, p_size * 10 AS low, p_size * 10 + p_partkey % 90 AS high FROM part),
  f AS (SELECT order_key, part_key, street AS street_key, CAST(order_key % 600 AS INT) AS number FROM tickets) """


def _segments(s, d):
    n, k = F.col("p_size") * 10, F.col("p_partkey")
    return table(s, d, "part").select(F.col("p_type").alias("street_key"), k.alias("segment_id"), (k % 2).alias("parity"), n.alias("low"), (n + k % 90).alias("high"))


@query(
    "JOI15_range_match",
    TK + _SEG + """, g AS (SELECT DISTINCT street_key, number FROM f), j AS (SELECT g.*, segment_id, number BETWEEN low AND high AND parity = number % 2 AS inside, CASE WHEN number BETWEEN low AND high THEN 0 ELSE least(abs(number - low), abs(number - high)) END AS gap,
      high - low AS span FROM g JOIN seg USING (street_key)),
    r AS (SELECT street_key, number, segment_id, inside, CASE WHEN inside THEN 0 ELSE gap END AS off, row_number() OVER (PARTITION BY street_key, number ORDER BY inside DESC, CASE WHEN inside THEN span ELSE gap END, segment_id) AS rn FROM j)
    SELECT DISTINCT order_key * 100000 + part_key AS id, segment_id, inside, CAST(off AS BIGINT) AS off FROM f JOIN r USING (street_key, number) WHERE rn = 1""",
)
def range_match(s, d):
    ident = F.col("order_key") * 100000 + F.col("part_key")
    facts = tickets(s, d).select(ident.alias("id"), F.col("street").alias("street_key"), (F.col("order_key") % 600).cast("int").alias("number")).distinct()
    return joins.range_matched(facts, _segments(s, d), "id", "number").select("id", "segment_id", "inside", "off")


@query(
    "JOI16_fallback_chain",
    """WITH k AS (SELECT 'QUEEN STREET' AS name, 1 AS sid UNION ALL SELECT 'KINGSTREET', 2 UNION ALL SELECT 'MAIN STREET NB', 3 UNION ALL SELECT 'OCONNOR DRIVE PARK ON AVENUE1', 4 UNION ALL SELECT 'YONGE STREET BLOOR STREET', 5 UNION ALL SELECT 'ELM GROVE COURT', 6)
    SELECT c_custkey AS id, sid, method FROM customer JOIN (VALUES (0, 'MAIN STREET NB', 'exact'), (1, 'KINGSTREET', 'no_space'), (2, 'QUEEN STREET', 'no_direction'), (3, 'YONGE STREET BLOOR STREET', 'no_direction'), (5, 'ELM GROVE COURT', 'fuzzy')) t(shape, name, method)
      ON c_custkey % 8 = shape JOIN k USING (name) UNION ALL SELECT c_custkey, 4, CASE WHEN c_custkey % 3 = 1 THEN 'no_space' ELSE 'fuzzy' END FROM customer WHERE c_custkey % 8 = 7""",
)
def fallback_chain(s, d):
    """All spellings of addresses by the key of their street, the last step by likeness; those of no known street are left out."""
    from curbside.functions import text

    names = ["QUEEN STREET", "KINGSTREET", "MAIN STREET NB", "OCONNOR DRIVE PARK ON AVENUE1", "YONGE STREET BLOOR STREET", "ELM GROVE COURT"]
    streets = s.createDataFrame([(name, k + 1) for k, name in enumerate(names)], "name string, sid int")
    place = F.regexp_replace(text.without_position_words(F.col("address")), "^[0-9]+-", "")
    facts = addresses(s, d).select("id", text.street_key(text.without_house_number(place)).alias("key"))
    bare = text.without_direction(F.col("key"))
    steps = [("exact", F.col("key"), F.col("name")), ("no_direction", bare, F.col("name")), ("no_space", F.replace(bare, F.lit(" ")), F.replace(F.col("name"), F.lit(" ")))]
    return joins.fallback_chain(facts, streets, steps, "id", (F.col("key"), "name")).select("id", "sid", "method")


@query(
    "JOI17_fuzzy_match",
    """SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN concat(p_type, 'X') WHEN 1 THEN substr(p_type, 2) WHEN 2 THEN replace(p_type, ' ', '') ELSE p_type END AS typed, p_type AS known FROM part""",
)
def fuzzy_match(s, d):
    """Misspelt names meet the known ones by their ratio; only distinct names are compared. The SQL knows which name each one was made from."""
    known = table(s, d, "part").select(F.col("p_type").alias("known")).distinct()
    k = F.col("p_partkey") % 4
    spoilt = F.when(k == 0, F.concat("p_type", F.lit("X"))).when(k == 1, F.regexp_replace("p_type", "^.", "")).when(k == 2, F.replace("p_type", F.lit(" "))).otherwise(F.col("p_type"))
    return joins.nearest_names(table(s, d, "part").select(spoilt.alias("typed")), known).select("typed", "known")


@query(
    "JOI18_nearest_pair",
    PT + """, a AS (SELECT area, point_key, lon, lat FROM points WHERE segment = 'BUILDING'), b AS (SELECT area, point_key, lon, lat FROM points WHERE segment = 'MACHINERY'),
    j AS (SELECT a.area, a.point_key AS id_a, b.point_key AS id_b, row_number() OVER (PARTITION BY a.area ORDER BY round(sqrt(((a.lat - b.lat) * 111320) ** 2 + ((a.lon - b.lon) * 78850) ** 2), 6), a.point_key, b.point_key) AS rn FROM a JOIN b ON a.area = b.area)
    SELECT area, id_a, id_b FROM j WHERE rn = 1""",
)
def nearest_pair(s, d):
    p = points(s, d).select("area", F.col("point_key").alias("segment_id"), "lon", "lat", "segment")
    return joins.nearest_pairs(p.filter("segment = 'BUILDING'").drop("segment"), p.filter("segment = 'MACHINERY'").drop("segment"), "area").select("area", "id_a", "id_b")


@query("JOI19_first_candidate", "SELECT o_orderkey, coalesce(a.n_name, b.n_name) AS place FROM orders LEFT JOIN nation a ON a.n_nationkey = o_custkey % 40 LEFT JOIN nation b ON b.n_nationkey = o_orderkey % 25 WHERE coalesce(a.n_name, b.n_name) IS NOT NULL")
def first_candidate(s, d):
    keys = F.array(F.col("o_custkey") % 40, F.col("o_orderkey") % 25)
    lookup = table(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("place"))
    return joins.by_candidates(table(s, d, "orders"), "o_orderkey", keys, lookup, "k").select("o_orderkey", "place")


@query("JOI20_composite_key", "SELECT p_partkey, n FROM part JOIN (SELECT p_brand AS b, p_type AS t, count(*) AS n FROM part GROUP BY ALL) ON p_brand = b AND p_type = t")
def composite_key(s, d):
    p = table(s, d, "part")
    key = F.concat_ws(" & ", "p_brand", "p_type").alias("k")
    return p.select("p_partkey", key).join(p.groupBy(key).agg(F.count("*").alias("n")), "k").select("p_partkey", "n")


@query("JOI21_template_keys", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'bare' ELSE 'short' END AS found FROM nation")
def template_keys(s, d):
    n = table(s, d, "nation")
    kind = F.when(F.col("n_nationkey") % 3 == 0, "full").when(F.col("n_nationkey") % 3 == 1, "bare").otherwise("short")
    spelt = F.when(kind == "full", F.concat("n_name", F.lit(", Toronto, ON"))).when(kind == "bare", F.col("n_name")).otherwise(F.concat("n_name", F.lit(", TORONTO")))
    lookup = n.select(spelt.alias("k"), kind.alias("found"))
    tries = F.array(F.concat("n_name", F.lit(", Toronto, ON")), F.col("n_name"), F.concat("n_name", F.lit(", TORONTO")))
    return joins.by_candidates(n, "n_nationkey", tries, lookup, "k").select("n_nationkey", "found")


@query("JOI22_polygon_attributes", PT + _HOODS + ", n AS (SELECT polygon, count(*) AS n, sum(amount) AS total FROM first JOIN points USING (point_key) GROUP BY 1) SELECT polygon AS name, k AS position, coalesce(n, 0) AS n, CAST(coalesce(total, 0) AS DECIMAL(28,2)) AS total FROM b LEFT JOIN n USING (polygon)")
def polygon_attributes(s, d):
    """What lies in each shape, put onto the shapes; those without anything get zeros."""
    shapes = _boxes(s)
    held = in_polygons(points(s, d), shapes).filter("polygon IS NOT NULL").groupBy("polygon").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    return joins.enriched(shapes, held, "polygon", {"n": 0, "total": 0}).select(F.col("polygon").alias("name"), "position", "n", F.col("total").cast("decimal(28,2)").alias("total"))


@query("JOI23_compared", LT + _OUTER + "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) - coalesce(b.n, 0) AS difference FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def compared(s, d):
    return joins.compared(*_halves(s, d), "k", "n").select("k", "difference")


@query("JOI24_near_duplicates_in_time", TG + "SELECT a.officer, a.tag AS id_a, b.tag AS id_b FROM tags a JOIN tags b ON a.officer = b.officer AND a.place = b.place AND (b.ts > a.ts OR (b.ts = a.ts AND b.tag > a.tag)) AND epoch_us(b.ts) - epoch_us(a.ts) <= 3600000000")
def near_duplicates_in_time(s, d):
    return joins.near_in_time(tags(s, d), ["officer", "place"], "tag", "ts", 3600).select("officer", "id_a", "id_b")


@query("JOI25_one_row_parameters", "SELECT count(*) AS n FROM part, (SELECT 10 AS low, 20 AS high) WHERE p_size BETWEEN low AND high")
def one_row_parameters(s, d):
    bounds = s.range(1).select(F.lit(10).alias("low"), F.lit(20).alias("high"))
    return table(s, d, "part").crossJoin(F.broadcast(bounds)).filter("p_size BETWEEN low AND high").agg(F.count("*").alias("n"))


_OVERLAP = "greatest(0, least({0} + {2}, -79.23) - greatest({0}, -79.53)) * greatest(0, least({1} + {3}, 43.76) - greatest({1}, 43.61))"


@query(
    "JOI26_ward_export",
    ST + """, t AS (SELECT ward_code, count(*) AS n, CAST(sum(balance) AS DECIMAL(28,2)) AS total FROM sites GROUP BY 1), w AS (SELECT n_nationkey AS ward_code, n_name AS name, -79.6::DOUBLE + (n_nationkey % 5) * 0.1::DOUBLE AS x, 43.58::DOUBLE + (n_nationkey // 5) * 0.05::DOUBLE AS y FROM nation),
    """ + f"""c AS (SELECT *, {_OVERLAP.format("x", "y", "0.1", "0.05")} AS whole, {_OVERLAP.format("(x + 0.03)", "(y + 0.01)", "0.03", "0.02")} AS hole FROM w)
    SELECT ward_code, name, coalesce(n, 0) AS ticket_count, coalesce(total, 0) AS total_revenue, CASE WHEN hole > 1e-12 THEN 2 ELSE 1 END AS n_rings, round(CAST(whole - hole AS DOUBLE), 8) AS area FROM c LEFT JOIN t USING (ward_code) WHERE whole > 1e-12""",
)
def ward_export(s, d):
    """Wards, each with a hole, cut to the area of interest, with the totals of all wards; those outside of it are left out."""
    k = F.col("n_nationkey")
    placed = table(s, d, "nation").select(k.alias("ward_code"), F.col("n_name").alias("name"), (F.lit(-79.6) + (k % 5) * 0.1).alias("x"), (F.lit(43.58) + F.floor(k / 5) * 0.05).alias("y"))
    x, y = F.col("x"), F.col("y")
    wards = placed.withColumn("rings", F.array(_box(x, y, F.lit(0.1), F.lit(0.05)), F.reverse(_box(x + 0.03, y + 0.01, F.lit(0.03), F.lit(0.02)))))
    cut = clipped(wards, "rings", -79.53, 43.61, -79.23, 43.76).filter(F.size("rings") > 0)
    totals = sites(s, d).groupBy("ward_code").agg(F.count("*").alias("ticket_count"), F.sum("balance").cast("decimal(28,2)").alias("total_revenue"))
    rows = joins.enriched(cut, totals, "ward_code", {"ticket_count": 0, "total_revenue": 0})
    return rows.select("ward_code", "name", "ticket_count", F.col("total_revenue").cast("decimal(28,2)").alias("total_revenue"), F.size("rings").alias("n_rings"), F.round(area(F.col("rings")), 8).alias("area"))


# Sets.
@query("SET01_padded_union", ST + "SELECT 'cluster' AS kind, division AS name, count(*) AS n FROM sites GROUP BY division UNION ALL SELECT 'point', site_name, NULL FROM sites")
def padded_union(s, d):
    t = sites(s, d)
    clusters = t.groupBy(F.col("division").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("cluster"))
    return clusters.unionByName(t.select(F.lit("point").alias("kind"), F.col("site_name").alias("name")), allowMissingColumns=True)


@query("SET02_zoom_variants", "SELECT n_nationkey, z FROM nation, (VALUES (8), (12), (16)) v(z)")
def zoom_variants(s, d):
    return table(s, d, "nation").select("n_nationkey", F.explode(F.array(F.lit(8), F.lit(12), F.lit(16))).alias("z"))


@query("SET03_table_counts", "SELECT 'nation' AS t, count(*) AS n FROM nation UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders")
def table_counts(s, d):
    counts = [table(s, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t in ("nation", "part", "orders")]
    return counts[0].union(counts[1]).union(counts[2])


@query("SET04_key_union", LT + _OUTER + "SELECT k FROM a UNION SELECT k FROM b")
def key_union(s, d):
    a, b = _halves(s, d)
    return a.select("k").union(b.select("k")).distinct()


@query("SET05_priority_merge", "SELECT k, min(p) AS p FROM (SELECT c_nationkey AS k, 1 AS p FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT s_nationkey, 2 FROM supplier UNION ALL SELECT n_nationkey, 3 FROM nation) GROUP BY k")
def priority_merge(s, d):
    parts = [table(s, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("k"), F.lit(1).alias("p")), table(s, d, "supplier").select("s_nationkey", F.lit(2)), table(s, d, "nation").select("n_nationkey", F.lit(3))]
    return top_per_group(parts[0].union(parts[1]).union(parts[2]), ["k"], ["p"]).drop("rn")


@query("SET06_distinct_sorted", "SELECT DISTINCT p_brand, p_type FROM part ORDER BY 1, 2")
def distinct_sorted(s, d):
    return table(s, d, "part").select("p_brand", "p_type").distinct().orderBy("p_brand", "p_type")


@query("SET07_first_seen", "SELECT p_name, min(p_partkey) AS seen FROM part GROUP BY 1 ORDER BY 2")
def first_seen(s, d):
    return table(s, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("seen")).orderBy("seen")


@query("SET08_example_dedupe", LT + "SELECT split, prompt, min(order_key) AS order_key FROM (SELECT CASE WHEN month IN (3, 10, 11, 12) THEN 'eval' ELSE 'train' END AS split, description || ' ' || site_key AS prompt, order_key FROM line_tickets) GROUP BY split, prompt")
def example_dedupe(s, d):
    from curbside.operators.corpus import distinct_examples, split_of

    rows = line_tickets(s, d).select(split_of(F.col("month")).alias("split"), F.concat_ws(" ", "description", "site_key").alias("prompt"), F.lit("").alias("completion"), "order_key")
    return distinct_examples(rows, "order_key").select("split", "prompt", "order_key")


@query("SET09_split_sizes", "SELECT lang, count(*) AS n FROM documents WHERE trim(text) <> '' GROUP BY lang")
def split_sizes(s, d):
    return table(s, d, "documents").filter(F.trim("text") != "").groupBy("lang").agg(F.count("*").alias("n"))


@query("SET10_ticket_hash", LT + "SELECT ticket_number, md5(concat_ws('|', ticket_number, CAST(ticket_date AS VARCHAR), code, description, CAST(fine AS VARCHAR), '')) AS h FROM line_tickets")
def ticket_hash(s, d):
    from curbside.functions.values import ticket_hash as digest

    fields = [F.col(c) for c in ("ticket_number", "ticket_date", "code", "description", "fine")]
    return line_tickets(s, d).select("ticket_number", digest(*fields, F.lit(None)).alias("h"))


@query("SET11_covering_tiles", PT + "SELECT DISTINCT z, CAST(floor((lon + 180) / 360 * (1 << z)) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * (1 << z)) AS BIGINT) AS y FROM points, (VALUES (8), (9), (10)) v(z)")
def covering_tiles(s, d):
    from curbside.operators.tiles import covering

    return covering(points(s, d), [8, 9, 10])


# Sorts and samples.
def _top(name, sql, keys, order):
    @query(name, TK + sql)
    def run(s, d, limit=10):
        return totals(tickets(s, d), keys).orderBy(*[F.desc(c) for c in order], *keys).limit(limit)


_top("TOP01_streets", "SELECT street, count(*) AS ticket_count, CAST(sum(fine) AS DECIMAL(28,2)) AS total_revenue FROM tickets GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10", ["street"], ["ticket_count", "total_revenue"])
_top("TOP02_neighbourhoods", "SELECT brand, count(*) AS ticket_count, CAST(sum(fine) AS DECIMAL(28,2)) AS total_revenue FROM tickets GROUP BY 1 ORDER BY 3 DESC, 2 DESC, 1 LIMIT 10", ["brand"], ["total_revenue", "ticket_count"])


@query("TOP03_camera_sites", f"WITH {LINE_TICKETS_SQL}, {SITES_SQL} SELECT site_key, count(*) AS n, CAST(sum(fine) AS DECIMAL(28,2)) AS fines FROM line_tickets JOIN sites USING (site_key) GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10")
def camera_sites(s, d):
    per_site = line_tickets(s, d).groupBy("site_key").agg(F.count("*").alias("n"), F.sum("fine").cast("decimal(28,2)").alias("fines"))
    return per_site.join(sites(s, d).filter("lon IS NOT NULL").select("site_key"), "site_key", "left_semi").orderBy(F.desc("n"), F.desc("fines"), "site_key").limit(10)


@query("TOP04_camera_wards", f"WITH {LINE_TICKETS_SQL}, {SITES_SQL} SELECT ward, count(*) AS n FROM line_tickets JOIN sites USING (site_key) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def camera_wards(s, d):
    per_site = line_tickets(s, d).groupBy("site_key").agg(F.count("*").alias("n"))
    return per_site.join(sites(s, d).select("site_key", "ward"), "site_key").groupBy("ward").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ward").limit(10)


@query("TOP05_nulls_last", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size END AS v FROM part ORDER BY v DESC NULLS LAST, p_partkey LIMIT 25")
def nulls_last(s, d):
    return table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("v")).orderBy(F.desc_nulls_last("v"), "p_partkey").limit(25)


@query("TOP06_page", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page(s, d):
    return table(s, d, "orders").select("o_orderkey").orderBy("o_orderkey").offset(100).limit(50)


@query("TOP07_ordered_sample", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20")
def ordered_sample(s, d):
    return table(s, d, "customer").select("c_custkey", "c_name").orderBy("c_custkey").limit(20)


@query("TOP08_largest", TG + "SELECT tag, fine FROM tags ORDER BY fine DESC, tag LIMIT 10")
def largest(s, d):
    return tags(s, d).select("tag", "fine").orderBy(F.desc("fine"), "tag").limit(10)


_SAMPLE = "CAST('0x' || substr(md5(CAST(point_key AS VARCHAR)), 1, 8) AS BIGINT)"


@query("TOP09_stable_sample", PT + f"SELECT point_key FROM points ORDER BY {_SAMPLE}, point_key LIMIT 100")
def stable_sample(s, d):
    from curbside.operators.sampling import hash_ordered

    return hash_ordered(points(s, d), "point_key", 100).select("point_key")


@query("TOP10_partial_flag", PT + "SELECT segment, count(*) AS available, count(*) > 250 AS partial FROM points GROUP BY 1")
def partial_flag(s, d, limit=250):
    return points(s, d).groupBy("segment").agg(F.count("*").alias("available")).withColumn("partial", F.col("available") > limit)


@query("TOP11_seeded_sample", "SELECT CAST(count(*) // 10 AS BIGINT) AS n FROM conversations")
def seeded_sample(s, d):
    """A tenth of the rows by a seeded order; which rows depends on the seed only."""
    from curbside.operators.sampling import seeded

    df = table(s, d, "conversations").select("conv_id", "turn")
    return seeded(df, ["conv_id", "turn"], 0.1, 7).agg(F.count("*").alias("n"))


@query("TOP12_frame_sample", "SELECT count(*) AS n FROM (SELECT c_custkey FROM customer LIMIT 100)")
def frame_sample(s, d):
    from curbside.operators.sampling import hash_ordered

    return hash_ordered(table(s, d, "customer"), "c_custkey", 100).agg(F.count("*").alias("n"))


@query("TOP13_frequent", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 5 ORDER BY 2 DESC, 1 LIMIT 50")
def frequent(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n >= 5").orderBy(F.desc("n"), "o_custkey").limit(50)


@query("TOP14_count_then_key", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1")
def count_then_key(s, d):
    return table(s, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_name")


@query("TOP15_without_unknown", TK + "SELECT location, CAST(sum(fine) AS DECIMAL(28,2)) AS fines FROM tickets WHERE location <> 'red widget' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def without_unknown(s, d):
    return tickets(s, d).filter("location <> 'red widget'").groupBy("location").agg(F.sum("fine").cast("decimal(28,2)").alias("fines")).orderBy(F.desc("fines"), "location").limit(10)


@query("TOP16_tile_order", PT + ", t AS (SELECT DISTINCT CAST(floor((lon + 180) / 360 * 512) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 512) AS BIGINT) AS y FROM points) SELECT x, y, array_to_string(list_transform(range(8, -1, -1), lambda k: (x >> k) % 2 + 2 * ((y >> k) % 2)), '') AS q FROM t")
def tile_order(s, d):
    from curbside.functions.geo import quadkey
    from curbside.operators.tiles import covering

    t = covering(points(s, d), [9]).select("x", "y", quadkey(F.col("x"), F.col("y"), 9).alias("q"))
    return t.repartitionByRange("q").sortWithinPartitions("q", "x", "y")
