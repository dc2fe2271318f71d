"""Registered queries over the scalar functions: text, dates, geometry, numbers, JSON (STG, DAT, MTH, ARR, MAP, JSN, PRJ)."""

from __future__ import annotations

from pyspark.sql import functions as F

from curbside.functions import dates, geo, text, values
from curbside.plans.registry import query
from curbside.sources.tables import ADDRESSES_SQL, LINE_TICKETS_SQL, POINTS_SQL, SITES_SQL, TAGS_SQL, addresses, line_tickets, points, sites, table, tags


def _address(name, sql, column):
    query(name, f"WITH {ADDRESSES_SQL} SELECT id, {sql} AS v FROM addresses")(lambda s, d: addresses(s, d).select("id", column(F.col("address")).alias("v")))


_ALNUM = "trim(regexp_replace(upper(address), '[^A-Z0-9]+', ' ', 'g'))"
_KEY = (
    "array_to_string(list_transform(string_split({0}, ' '), lambda t: CASE t WHEN 'ST' THEN 'STREET' WHEN 'RD' THEN 'ROAD' WHEN 'AVE' THEN 'AVENUE' WHEN 'AV' THEN 'AVENUE' WHEN 'BLVD' THEN 'BOULEVARD' WHEN 'BL' THEN 'BOULEVARD' "
    "WHEN 'DR' THEN 'DRIVE' WHEN 'PKWY' THEN 'PARKWAY' WHEN 'HWY' THEN 'HIGHWAY' WHEN 'CRES' THEN 'CRESCENT' WHEN 'CR' THEN 'CRESCENT' WHEN 'CIR' THEN 'CIRCLE' WHEN 'CRT' THEN 'COURT' WHEN 'CT' THEN 'COURT' WHEN 'PL' THEN 'PLACE' "
    "WHEN 'PLZ' THEN 'PLAZA' WHEN 'SQ' THEN 'SQUARE' WHEN 'TER' THEN 'TERRACE' WHEN 'TRL' THEN 'TRAIL' WHEN 'LN' THEN 'LANE' WHEN 'PK' THEN 'PARK' WHEN 'EXPY' THEN 'EXPRESSWAY' WHEN 'E' THEN 'EAST' WHEN 'W' THEN 'WEST' WHEN 'N' THEN 'NORTH' "
    "WHEN 'S' THEN 'SOUTH' WHEN 'NE' THEN 'NORTHEAST' WHEN 'NW' THEN 'NORTHWEST' WHEN 'SE' THEN 'SOUTHEAST' WHEN 'SW' THEN 'SOUTHWEST' ELSE t END), ' ')"
)
_address("STG01_clean_address", "nullif(upper(trim(address)), '')", text.clean_address)
_address(
    "STG02_street_of_location",
    r"nullif(trim(regexp_replace(trim(regexp_replace(regexp_replace(upper(address), '\b(NB|SB|EB|WB)\b', '', 'g'), '\s+', ' ', 'g')), '^[0-9\- ]+', '')), '')",
    text.street_of_location,
)
_address("STG03_street_label", r"coalesce(nullif(trim(regexp_replace(upper(trim(address)), '^[0-9]+\s*', '')), ''), 'Unknown')", text.street_label)
_address("STG04_alnum_tokens", _ALNUM, text.alnum_tokens)
_address("STG05_street_key", _KEY.format(_ALNUM), text.street_key)
_NUMBERS = rf"regexp_extract(concat({_ALNUM}, ' '), '^(\d+[A-Z]? (?:\d+ )*(?:\d+[A-Z] )?)', 1)"
_address("STG06_house_number", rf"TRY_CAST(regexp_extract({_NUMBERS}, '(\d+)[A-Z]? $', 1) AS INT)", text.house_number)
_address(
    "STG06_numbered_street",
    rf"""(SELECT trim(CASE WHEN letter = '' THEN rest WHEN len(string_split(trim(numbers), ' ')) > 1 THEN concat(letter, ' ', rest) WHEN contains(rest, letter) THEN rest ELSE concat(rest, ' ', letter) END)
      FROM (SELECT numbers, regexp_extract(numbers, '\d([A-Z]) $', 1) AS letter, trim(substr(concat({_ALNUM}, ' '), length(numbers) + 1)) AS rest FROM (SELECT {_NUMBERS} AS numbers)))""",
    text.numbered_street,
)
_SIDES = [f"list_filter(list_transform(string_split(upper(address), '{m}'), lambda x: trim(x)), lambda x: x <> '')" for m in text.INTERSECTION_MARKS]


@query(
    "STG07_intersection_streets",
    f"""WITH {ADDRESSES_SQL}, p AS (SELECT id, coalesce({", ".join(f"CASE WHEN len({x}) >= 2 THEN {x} END" for x in _SIDES)}) AS s FROM addresses)
    SELECT id, {_KEY.format("trim(regexp_replace(s[1], '[^A-Z0-9]+', ' ', 'g'))")} AS a, {_KEY.format("trim(regexp_replace(s[2], '[^A-Z0-9]+', ' ', 'g'))")} AS b FROM p WHERE s IS NOT NULL""",
)
def intersection_streets(s, d):
    two = addresses(s, d).select("id", text.intersection_streets(F.col("address")).alias("s")).filter("s IS NOT NULL")
    return two.select("id", F.col("s")[0].alias("a"), F.col("s")[1].alias("b"))


_address("STG08_without_position_words", rf"regexp_replace(trim(upper(address)), '^((?:{'|'.join(sorted(text.POSITION_WORDS, key=len, reverse=True))})\s+)+', '')", text.without_position_words)
_address(
    "STG09_address_candidates",
    rf"array_to_string(list_sort(list_distinct([{_ALNUM}, trim(regexp_replace({_ALNUM}, '\b(NEAR|OF|THE)\b', '', 'g')), trim(regexp_replace({_ALNUM}, '\b(N|S|E|W)$', '')), regexp_replace({_ALNUM}, '^\d{{1,6}}[A-Z]? ', '')])), ';')",
    lambda c: F.array_join(F.array_sort(text.address_candidates(c)), ";"),
)
_address(
    "STG10_title_case",
    "array_to_string(list_transform(regexp_extract_all(lower(address), '([a-z]+|[^a-z]+)'), lambda x: concat(upper(x[1]), x[2:])), '')",
    text.title_case,
)


@query(
    "STG11_composed_location",
    """SELECT p_partkey, concat_ws(', ', nullif(trim(p_name), ''), nullif(concat_ws(' / ', CASE WHEN p_size % 2 = 0 THEN p_type END, CASE WHEN p_size % 3 = 0 THEN p_brand END), ''),
      CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'ANNEX' END) AS location FROM part""",
)
def composed_location(s, d):
    even, third = F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))
    descriptor = F.when(F.col("p_size") % 5 == 0, "nr").otherwise("ANNEX")
    return table(s, d, "part").select("p_partkey", text.composed_location(F.col("p_name"), even, third, descriptor).alias("location"))


_WARD = "CASE s_suppkey % 5 WHEN 0 THEN 'Ward ' || (s_suppkey % 26) WHEN 1 THEN concat(s_suppkey % 26, '.0') WHEN 2 THEN 'Name (' || (s_suppkey % 26) || ')' WHEN 3 THEN concat(s_suppkey * 10) ELSE 'Old Town ' || (s_suppkey % 26) END"


def _wards(s, d):
    return table(s, d, "supplier").select("s_suppkey", F.expr(_WARD).alias("w"))


@query(
    "STG12_ward_name",
    f"SELECT s_suppkey, CASE WHEN TRY_CAST(trim(w) AS DOUBLE) = floor(TRY_CAST(trim(w) AS DOUBLE)) THEN 'Ward ' || CAST(CAST(TRY_CAST(trim(w) AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE trim(w) END AS v FROM (SELECT s_suppkey, {_WARD} AS w FROM supplier)",
)
def ward_name(s, d):
    return _wards(s, d).select("s_suppkey", text.ward_name(F.col("w")).alias("v"))


@query(
    "STG13_ward_code",
    f"""WITH RECURSIVE n AS (SELECT s_suppkey, TRY_CAST(regexp_extract({_WARD}, '(\\d+)', 1) AS INT) AS n FROM supplier UNION ALL SELECT s_suppkey, n // 10 FROM n WHERE n > 25 AND n % 10 = 0)
    SELECT s_suppkey, min(n) AS v FROM n GROUP BY s_suppkey""",
)
def ward_code(s, d):
    return _wards(s, d).select("s_suppkey", text.ward_code(F.col("w")).alias("v"))


@query(
    "STG14_ward_code_and_name",
    f"""SELECT s_suppkey, CAST(coalesce(nullif(regexp_extract(w, '\\((\\d{{1,2}})\\)', 1), ''), nullif(regexp_extract(w, '(?i)ward\\s+(\\d{{1,2}})', 1), ''), nullif(regexp_extract(w, '(\\d{{1,2}})\\s*$', 1), '')) AS INT) AS code,
      nullif(trim(regexp_replace(regexp_replace(w, '\\(\\d{{1,2}}\\)', '', 'g'), '(?i)^ward\\s+\\d{{1,2}}$|\\s+\\d{{1,2}}\\s*$', '', 'g')), '') AS name FROM (SELECT s_suppkey, {_WARD} AS w FROM supplier)""",
)
def ward_code_and_name(s, d):
    return _wards(s, d).select("s_suppkey", text.ward_code_and_name(F.col("w")).alias("x")).select("s_suppkey", "x.code", "x.name")


_address("STG15_slug", "regexp_replace(regexp_replace(lower(trim(address)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')", text.slug)


@query("STG16_plain_key", "SELECT doc_id, md5(lower(strip_accents(text))) AS k FROM documents")
def plain_key(s, d):
    from curbside.functions.slow import plain_letters

    return table(s, d, "documents").select("doc_id", F.md5(F.lower(plain_letters(F.col("text")))).alias("k"))


@query("STG17_masked_number", "SELECT c_custkey, TRY_CAST(replace(CASE WHEN c_custkey % 7 = 0 THEN '***' ELSE '***0' || c_custkey END, '*', '') AS BIGINT) AS n FROM customer")
def masked_number(s, d):
    masked = F.when(F.col("c_custkey") % 7 == 0, "***").otherwise(F.concat(F.lit("***0"), F.col("c_custkey").cast("string")))
    return table(s, d, "customer").select("c_custkey", text.masked_number(masked).alias("n"))


@query("STG18_digests", "SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s2 FROM customer")
def digests(s, d):
    return table(s, d, "customer").select("c_custkey", F.md5("c_name").alias("m"), F.sha1("c_name").alias("s1"), F.sha2("c_name", 256).alias("s2"))


@query("STG19_packed_payload", "SELECT segment, count(*) AS n, true AS same FROM (SELECT c_mktsegment AS segment FROM customer) GROUP BY segment")
def packed_payload(s, d):
    """Payloads packed as gzip + base64 and unpacked again."""
    from curbside.functions.slow import packed, unpacked

    groups = table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    raw = F.to_json(F.struct("segment", "n"))
    return groups.select("segment", "n", (unpacked(packed(raw)) == raw).alias("same"))


@query("STG20_labels", "SELECT DISTINCT concat(substr(p_type, 1, 3), ': ', substr(p_name, 1, 10)) AS label FROM part")
def labels(s, d):
    return table(s, d, "part").select(F.concat(F.substring("p_type", 1, 3), F.lit(": "), F.substring("p_name", 1, 10)).alias("label")).distinct()


# Dates. Texts are derived from order numbers, so that every format and every failure occurs.
_DATE = "CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 3 THEN '2010-13-45' ELSE 'n/a' END"
_TIME = "CASE o_orderkey % 6 WHEN 0 THEN '2400' WHEN 1 THEN lpad(concat(o_orderkey % 24), 2, '0') || lpad(concat(o_orderkey % 60), 2, '0') WHEN 2 THEN '2560' WHEN 3 THEN concat(o_orderkey % 10, '30') WHEN 4 THEN '' ELSE '9:15' END"


def _date_texts(s, d):
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    return table(s, d, "orders").select(
        "o_orderkey",
        F.when(k % 5 == 0, F.date_format(t, "yyyyMMdd")).when(k % 5 == 1, F.date_format(t, "yyyy-MM-dd")).when(k % 5 == 2, F.date_format(t, "yyyy/MM/dd")).when(k % 5 == 3, "2010-13-45").otherwise("n/a").alias("d"),
        F.when(k % 6 == 0, "2400").when(k % 6 == 1, F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lpad((k % 60).cast("string"), 2, "0"))).when(k % 6 == 2, "2560")
        .when(k % 6 == 3, F.concat((k % 10).cast("string"), F.lit("30"))).when(k % 6 == 4, "").otherwise("9:15").alias("t"),
    )


_DATES_SQL = f"texts AS (SELECT o_orderkey, {_DATE} AS d, {_TIME} AS t FROM orders)"


@query("DAT01_parsed_date", f"WITH {_DATES_SQL} SELECT o_orderkey, CAST(coalesce(TRY_STRPTIME(d, '%Y%m%d'), TRY_STRPTIME(d, '%Y-%m-%d'), TRY_STRPTIME(d, '%Y/%m/%d')) AS DATE) AS v FROM texts")
def parsed_date(s, d):
    return _date_texts(s, d).select("o_orderkey", dates.parsed_date(F.col("d")).alias("v"))


@query("DAT02_clock", f"WITH {_DATES_SQL} SELECT o_orderkey, CASE WHEN regexp_full_match(t, '\\d{{4}}') THEN t[1:2] || ':' || t[3:4] ELSE nullif(t, '') END AS v FROM texts")
def clock(s, d):
    return _date_texts(s, d).select("o_orderkey", dates.clock(F.col("t")).alias("v"))


@query(
    "DAT03_minute_of_day",
    f"""WITH {_DATES_SQL}, p AS (SELECT o_orderkey, CASE WHEN t = '2400' THEN '0000' ELSE lpad(t, 4, '0') END AS t FROM texts)
    SELECT o_orderkey, CASE WHEN regexp_full_match(t, '\\d{{4}}') AND TRY_CAST(t[1:2] AS INT) < 24 AND TRY_CAST(t[3:4] AS INT) < 60 THEN TRY_CAST(t[1:2] AS INT) * 60 + TRY_CAST(t[3:4] AS INT) ELSE 720 END AS v FROM p""",
)
def minute_of_day(s, d):
    return _date_texts(s, d).select("o_orderkey", dates.minute_of_day(F.col("t")).alias("v"))


@query("DAT04_hour_and_minute", "SELECT event_id, CAST(least(greatest(event_id % 3000 // 100, 0), 23) AS INT) AS h, CAST(least(greatest(event_id % 3000 % 100, 0), 59) AS INT) AS m FROM events")
def hour_and_minute(s, d):
    h, m = dates.hour_and_minute(F.col("event_id") % 3000)
    return table(s, d, "events").select("event_id", h.alias("h"), m.alias("m"))


@query("DAT05_year_month", f"WITH {_DATES_SQL} SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN CAST(d[1:4] AS INT) END AS y, CASE WHEN o_orderkey % 5 = 0 THEN CAST(d[5:6] AS INT) END AS m FROM texts")
def year_month(s, d):
    y, m = dates.year_month(F.col("d"))
    return _date_texts(s, d).select("o_orderkey", y.alias("y"), m.alias("m"))


@query(
    "DAT06_calendar",
    "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day_of, dayname(o_orderdate) AS day_name, monthname(o_orderdate) AS month_name, isodow(o_orderdate) >= 6 AS is_weekend, CAST(isodow(o_orderdate) - 1 AS INT) AS weekday FROM orders",
)
def calendar(s, d):
    days = table(s, d, "orders").select(F.to_date("o_orderdate").alias("day_of")).distinct()
    c = dates.calendar(F.col("day_of"))
    return days.select("day_of", *[c[k].alias(k) for k in ("day_name", "month_name", "is_weekend", "weekday")])


@query("DAT07_iso_week", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day_of, CAST(week(o_orderdate) AS INT) AS w FROM orders")
def iso_week(s, d):
    return table(s, d, "orders").select(F.to_date("o_orderdate").alias("day_of")).distinct().select("day_of", F.weekofyear("day_of").alias("w"))


@query("DAT08_year_in_name", "SELECT o_orderkey, TRY_CAST(regexp_extract('Parking Tags ' || year(o_orderdate) || '.zip', '((?:19|20)\\d{2})', 1) AS INT) AS y FROM orders")
def year_in_name(s, d):
    return table(s, d, "orders").select("o_orderkey", dates.year_in_name(F.concat(F.lit("Parking Tags "), F.year("o_orderdate").cast("string"), F.lit(".zip"))).alias("y"))


@query("DAT09_year_list", f"WITH {LINE_TICKETS_SQL} SELECT year, count(*) AS n FROM line_tickets WHERE year IN (1995, 1996, 1997, 1999) GROUP BY year")
def year_list(s, d):
    return line_tickets(s, d).filter(F.col("year").isin(dates.year_list("1995-1997,1999"))).groupBy("year").agg(F.count("*").alias("n"))


@query("DAT10_floor_minutes", f"WITH {TAGS_SQL} SELECT tag, strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M') AS w FROM tags")
def floor_minutes(s, d):
    return tags(s, d).select("tag", F.date_format(dates.floor_minutes(F.col("ts")), "yyyy-MM-dd HH:mm").alias("w"))


@query("DAT11_local_time", "SELECT event_id, CAST(isodow(l) - 1 AS INT) AS wd, CAST(hour(l) AS INT) AS h FROM (SELECT event_id, ts - INTERVAL 5 HOUR AS l FROM events)")
def local_time(s, d):
    """January times in the city's own zone (UTC-5 in winter)."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/Toronto")
    return table(s, d, "events").select("event_id", F.weekday(local).alias("wd"), F.hour(local).alias("h"))


# Numbers and geometry.
@query("MTH01_money", "SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) / 8, 2) AS DECIMAL(18,2)) AS v FROM (SELECT o_orderkey, CAST(o_totalprice * 8 AS DECIMAL(18,2)) AS o_totalprice FROM orders)")
def money(s, d):
    return table(s, d, "orders").select("o_orderkey", values.money(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))


@query("MTH02_rounded", "SELECT event_id, round(value, 1) AS v FROM events")
def rounded(s, d):
    return table(s, d, "events").select("event_id", F.round("value", 1).alias("v"))


@query("MTH03_safe_number", "SELECT c_custkey, coalesce(TRY_CAST(CASE WHEN c_custkey % 3 = 0 THEN 'abc' WHEN c_custkey % 3 = 1 THEN '1' || lpad(concat(c_custkey), 3, '0') ELSE concat(c_custkey) END AS DOUBLE), 0) AS v FROM customer")
def safe_number(s, d):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, "abc").when(k % 3 == 1, F.concat(F.lit("$1,"), F.lpad(k.cast("string"), 3, "0"))).otherwise(k.cast("string"))
    return table(s, d, "customer").select("c_custkey", values.safe_number(raw).alias("v"))


@query("MTH04_modulo_and_floor", "SELECT event_id, CAST((event_id - 500) % 100 AS BIGINT) AS r, CAST(floor((event_id - 500) / 100.0) AS BIGINT) AS q FROM events")
def modulo_and_floor(s, d):
    n = F.col("event_id") - 500
    return table(s, d, "events").select("event_id", (n % 100).alias("r"), F.floor(n / 100).alias("q"))


_X = "CAST(floor((lon + 180) / 360 * {n}) AS BIGINT)"
_Y = "CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * {n}) AS BIGINT)"


@query("MTH05_tiles", f"WITH {POINTS_SQL} SELECT point_key, {_X.format(n=65536)} AS x, {_Y.format(n=65536)} AS y FROM points")
def tiles(s, d):
    return points(s, d).select("point_key", geo.tile_x(F.col("lon"), 16).alias("x"), geo.tile_y(F.col("lat"), 16).alias("y"))


@query(
    "MTH06_quadkey",
    f"""WITH {POINTS_SQL}, t AS (SELECT point_key, {_X.format(n=4096)} AS x, {_Y.format(n=4096)} AS y FROM points)
    SELECT point_key, array_to_string(list_transform(range(11, -1, -1), lambda k: (x >> k) % 2 + 2 * ((y >> k) % 2)), '') AS q FROM t""",
)
def quadkeys(s, d):
    return points(s, d).select("point_key", geo.quadkey(geo.tile_x(F.col("lon"), 12), geo.tile_y(F.col("lat"), 12), 12).alias("q"))


@query("MTH07_quadkey_tile", f"WITH {POINTS_SQL} SELECT point_key, 12 AS z, {_X.format(n=4096)} AS x, {_Y.format(n=4096)} AS y FROM points")
def quadkey_tile(s, d):
    keys = points(s, d).select("point_key", geo.quadkey(geo.tile_x(F.col("lon"), 12), geo.tile_y(F.col("lat"), 12), 12).alias("q"))
    return keys.select("point_key", geo.quadkey_tile(F.col("q")).alias("t")).select("point_key", "t.z", "t.x", "t.y")


@query(
    "MTH08_tiles_of_bounds",
    f"""WITH {SITES_SQL}, b AS (SELECT division, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM sites GROUP BY division)
    SELECT division, x, y FROM b, unnest(range({_X.format(n=1024).replace('lon', 'w')}, {_X.format(n=1024).replace('lon', 'e')} + 1)) AS u(x), unnest(range({_Y.format(n=1024).replace('lat', 'n')}, {_Y.format(n=1024).replace('lat', 's')} + 1)) AS v(y)""",
)
def tiles_of_bounds(s, d):
    b = sites(s, d).groupBy("division").agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    wide = b.select("division", F.explode(F.sequence(geo.tile_x(F.col("w"), 10), geo.tile_x(F.col("e"), 10))).alias("x"), "s", "n")
    return wide.select("division", "x", F.explode(F.sequence(geo.tile_y(F.col("n"), 10), geo.tile_y(F.col("s"), 10))).alias("y"))


@query(
    "MTH09_tiles_around",
    f"""WITH {SITES_SQL}, t AS (SELECT site_key, {_X.format(n=8)} AS x, {_Y.format(n=8)} AS y FROM sites)
    SELECT site_key, (SELECT count(DISTINCT ((x + dx + 8) % 8, least(greatest(y + dy, 0), 7))) FROM (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy) WHERE NOT ((x + dx + 8) % 8 = x AND least(greatest(y + dy, 0), 7) = y)) AS around,
      x * 2 AS child_x, y * 2 + 1 AS child_y FROM t""",
)
def tiles_around(s, d):
    t = sites(s, d).select("site_key", F.lit(3).cast("bigint").alias("z"), geo.tile_x(F.col("lon"), 3).alias("x"), geo.tile_y(F.col("lat"), 3).alias("y"))
    child = geo.child_tiles(F.col("z"), F.col("x"), F.col("y"))[2]
    return t.select("site_key", F.size(geo.neighbour_tiles(F.col("z"), F.col("x"), F.col("y"))).cast("bigint").alias("around"), child["x"].alias("child_x"), child["y"].alias("child_y"))


@query("MTH10_flat_distance", f"WITH {SITES_SQL} SELECT site_key, round(sqrt(((lat - 43.65) * 111320) ** 2 + ((lon + 79.38) * 78850) ** 2), 3) AS m FROM sites")
def flat_distance(s, d):
    return sites(s, d).select("site_key", F.round(geo.flat_distance(F.col("lat"), F.col("lon"), F.lit(43.65), F.lit(-79.38)), 3).alias("m"))


@query("MTH11_line_centroid", f"WITH {POINTS_SQL} SELECT area, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM points GROUP BY area")
def line_centroid(s, d):
    """Means of all vertices as partial sums; no line is gathered."""
    return points(s, d).groupBy("area").agg(F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"))


@query(
    "MTH12_glow_segments",
    f"""WITH {SITES_SQL}, a AS (SELECT *, unnest([0, 45, 90, 135]) AS angle, 90 + least(site_key, 2500) * 0.012::DOUBLE AS len FROM sites)
    SELECT site_key, angle, round(lon + len / 2 * cos(radians(angle)) / 78850, 7) AS lon2, round(lat + len / 2 * sin(radians(angle)) / 111320, 7) AS lat2 FROM a""",
)
def glow_segments(s, d):
    lines = sites(s, d).select("site_key", F.explode(geo.glow_segments(F.col("lon"), F.col("lat"), F.col("site_key"))).alias("l"))
    return lines.select("site_key", "l.angle", F.round("l.lon2", 7).alias("lon2"), F.round("l.lat2", 7).alias("lat2"))


@query("MTH13_bounding_box", f"WITH {POINTS_SQL} SELECT area, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM points GROUP BY area")
def bounding_box(s, d):
    box = [f(c).alias(f"{name}_{c}") for name, f in (("min", F.min), ("max", F.max)) for c in ("lon", "lat")]
    return points(s, d).groupBy("area").agg(*box)


@query("MTH14_snapped", f"WITH {POINTS_SQL} SELECT point_key, round(round(lon / 0.005) * 0.005, 6) AS lon, round(round(lat / 0.005) * 0.005, 6) AS lat FROM points")
def snapped(s, d):
    return points(s, d).select("point_key", F.round(geo.snapped(F.col("lon"), 0.005), 6).alias("lon"), F.round(geo.snapped(F.col("lat"), 0.005), 6).alias("lat"))


@query("MTH16_clamped", "SELECT event_id, least(greatest(value / 100, 0.1), 0.9) AS v FROM events")
def clamped(s, d):
    return table(s, d, "events").select("event_id", values.clamp(F.col("value") / 100, 0.1, 0.9).alias("v"))


# Arrays, maps, JSON.
@query("ARR01_pg_array", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '{}' ELSE '{' || (c_custkey % 9) || ',' || (c_custkey % 5) || '}' END AS v, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 2 END AS n FROM customer")
def pg_array(s, d):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, "{}").otherwise(F.concat(F.lit("{"), (k % 9).cast("string"), F.lit(", "), (k % 5).cast("string"), F.lit("}")))
    parsed = table(s, d, "customer").select("c_custkey", values.pg_array(raw).alias("a"))
    return parsed.select("c_custkey", values.pg_array_text(F.col("a")).alias("v"), F.size("a").alias("n"))


@query("ARR02_sorted_set", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS v FROM lineitem GROUP BY l_orderkey")
def sorted_set(s, d):
    codes = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("c"))
    return codes.select("l_orderkey", F.array_join(values.sorted_set(F.col("c")), ",").alias("v"))


@query("ARR03_clean_numbers", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS n, CAST(c_custkey AS DOUBLE) AS first FROM customer")
def clean_numbers(s, d):
    k = F.col("c_custkey")
    raw = F.array(F.lit("x"), k.cast("string"), F.when(k % 2 == 0, "7.5").otherwise("-"))
    return table(s, d, "customer").select("c_custkey", values.clean_numbers(raw, 2).alias("a")).select("c_custkey", F.size("a").alias("n"), F.col("a")[0].alias("first"))


@query("ARR04_merged_arrays", "SELECT vec_id, list_sort(list_distinct(list_concat([label], [label + 1, 3]))) AS v FROM embeddings")
def merged_arrays(s, d):
    return table(s, d, "embeddings").select("vec_id", F.array_sort(F.array_union(F.array("label"), F.array(F.col("label") + 1, F.lit(3)))).alias("v"))


@query("MAP01_merged_maps", f"WITH {LINE_TICKETS_SQL} SELECT site_key, code, count(*) AS n FROM line_tickets GROUP BY ALL")
def merged_maps(s, d):
    """Histograms of sites and years, merged by key to histograms of sites."""
    from curbside.operators.aggregates import histogram_map, merged_histograms

    yearly = histogram_map(line_tickets(s, d), ["site_key", "year"], "code")
    return merged_histograms(yearly, ["site_key"], "histogram").select("site_key", F.explode("histogram").alias("code", "n"))


@query("MAP02_map_get", f"WITH {LINE_TICKETS_SQL} SELECT site_key, count(*) FILTER (WHERE year = 1996) AS n1996, 0 AS n1900 FROM line_tickets GROUP BY site_key")
def map_get(s, d):
    from curbside.operators.aggregates import histogram_map

    h = histogram_map(line_tickets(s, d), ["site_key"], "year")
    return h.select("site_key", values.map_get(F.col("histogram"), F.lit(1996)).alias("n1996"), values.map_get(F.col("histogram"), F.lit(1900)).cast("int").alias("n1900"))


@query(
    "MAP03_top_entry",
    f"WITH {LINE_TICKETS_SQL} SELECT site_key, code AS top FROM (SELECT site_key, code, row_number() OVER (PARTITION BY site_key ORDER BY count(*) DESC, code) AS rn FROM line_tickets GROUP BY site_key, code) WHERE rn = 1",
)
def top_entry(s, d):
    from curbside.operators.aggregates import histogram_map

    return histogram_map(line_tickets(s, d), ["site_key"], "code").select("site_key", values.top_entry(F.col("histogram")).alias("top"))


@query("JSN01_counts_from_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def counts_from_json(s, d):
    return table(s, d, "events").select("event_id", values.counts_from_json(F.col("props"))["k"].alias("k"))


@query("JSN02_first_point", f"WITH {SITES_SQL} SELECT site_key, round(lon, 3) AS lon, round(lat, 3) AS lat FROM sites")
def first_point(s, d):
    pair = F.concat(F.lit("["), F.round("lon", 3).cast("string"), F.lit(","), F.round("lat", 3).cast("string"), F.lit("]"))
    raw = F.when(F.col("site_key") % 2 == 0, F.concat(F.lit('{"type":"Point","coordinates":'), pair, F.lit("}"))).otherwise(F.concat(F.lit('{"type":"MultiPoint","coordinates":['), pair, F.lit(",[0,0]]}")))
    return sites(s, d).select("site_key", values.first_point(raw).alias("p")).select("site_key", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


@query("JSN03_stable_digest", "SELECT c_custkey, sha1('{\"a\":' || c_custkey || ',\"b\":\"' || c_name || '\"}') AS v FROM customer")
def stable_digest(s, d):
    return table(s, d, "customer").select("c_custkey", values.stable_digest(b=F.col("c_name"), a=F.col("c_custkey")).alias("v"))


@query("JSN04_features", f"WITH {SITES_SQL} SELECT site_key, '{{\"type\":\"Feature\",\"properties\":{{\"ward\":\"' || ward || '\",\"n\":' || site_key || '}}}}' AS v FROM sites")
def features(s, d):
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("ward", F.col("site_key").alias("n")).alias("properties"))
    return sites(s, d).select("site_key", F.to_json(feature).alias("v"))


# Projections.
@query("PRJ01_display_label", "SELECT p_partkey, coalesce(CASE WHEN p_size % 4 = 0 THEN NULL ELSE nullif(p_name, 'red widget') END, CASE WHEN p_size % 3 = 0 THEN NULL ELSE concat_ws(' & ', p_brand, p_type) END, 'Unknown') AS label FROM part")
def display_label(s, d):
    name = F.when(F.col("p_size") % 4 != 0, F.nullif("p_name", F.lit("red widget")))
    pair = F.when(F.col("p_size") % 3 != 0, F.concat_ws(" & ", "p_brand", "p_type"))
    return table(s, d, "part").select("p_partkey", F.coalesce(name, pair, F.lit("Unknown")).alias("label"))


@query("PRJ02_alias_coalesce", "SELECT c_custkey AS id, c_name AS tag FROM customer")
def alias_coalesce(s, d):
    from curbside.sources.files import first_of

    df = table(s, d, "customer").withColumnRenamed("c_name", "TagNumberMasked")
    return df.select(F.col("c_custkey").alias("id"), first_of(df, "tag_number_masked", "ticket_number", "tagnumbermasked").alias("tag"))


_BANDS = "CASE WHEN fine <= 20000 THEN '1: <=20k' WHEN fine <= 40000 THEN '2: <=40k' WHEN fine <= 60000 THEN '3: <=60k' ELSE '4: >60k' END"


@query("PRJ03_fine_bands", f"WITH {LINE_TICKETS_SQL} SELECT {_BANDS} AS band, count(*) AS n FROM line_tickets GROUP BY 1")
def fine_bands(s, d):
    from curbside.operators.aggregates import band

    return line_tickets(s, d).groupBy(band(F.col("fine"), [20000, 40000, 60000], ["1: <=20k", "2: <=40k", "3: <=60k", "4: >60k"]).alias("band")).agg(F.count("*").alias("n"))


@query("PRJ04_part_of_day", "SELECT event_id, CASE WHEN hour(ts) <= 6 THEN 'Night' WHEN hour(ts) <= 12 THEN 'Morning' WHEN hour(ts) <= 18 THEN 'Afternoon' ELSE 'Evening' END AS p FROM events")
def part_of_day(s, d):
    return tags(s, d).select(F.col("tag").alias("event_id"), dates.part_of_day(F.hour("ts")).alias("p"))


@query("PRJ05_temporal_features", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, CAST(isodow(o_orderdate) - 1 AS INT) AS weekday, CAST(week(o_orderdate) AS INT) AS iso_week FROM orders")
def temporal_features(s, d):
    c = dates.calendar(F.to_date("o_orderdate"))
    return table(s, d, "orders").select("o_orderkey", *[c[k].alias(k) for k in ("year", "month", "weekday", "iso_week")])


@query("PRJ06_template", "SELECT c_custkey, 'Ticket ' || c_custkey || ' for ' || c_name || ' {unknown}' AS v FROM customer")
def template(s, d):
    return table(s, d, "customer").select("c_custkey", text.template("Ticket {id} for {name} {unknown}", {"id": F.col("c_custkey"), "name": F.col("c_name")}).alias("v"))


@query("PRJ07_abbreviated", "SELECT o_orderkey, CASE WHEN o_orderkey * 1000 >= 1000000 THEN printf('%.1f', floor(o_orderkey / 100.0::DOUBLE + 0.5) / 10) || 'M' WHEN o_orderkey * 1000 >= 1000 THEN printf('%.1f', o_orderkey * 1000 / 1000.0::DOUBLE) || 'K' ELSE concat(o_orderkey * 1000) END AS v FROM orders")
def abbreviated(s, d):
    return table(s, d, "orders").select("o_orderkey", values.abbreviated(F.col("o_orderkey") * 1000).alias("v"))


_STOPS = [(1, "faint"), (10, "low"), (100, "mid"), (1000, "high")]


@query("PRJ08_cluster_rule", "SELECT o_custkey, CASE WHEN n >= 20 THEN 'dense' WHEN n >= 10 THEN 'busy' ELSE 'sparse' END AS rule FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def cluster_rule(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select("o_custkey", values.stops(F.col("n"), [(10, "busy"), (20, "dense")], "sparse").alias("rule"))


@query("PRJ09_choropleth", "SELECT event_id, CASE WHEN value >= 1000 THEN 'high' WHEN value >= 100 THEN 'mid' WHEN value >= 10 THEN 'low' WHEN value >= 1 THEN 'faint' ELSE 'none' END AS c FROM events")
def choropleth(s, d):
    return table(s, d, "events").select("event_id", values.stops(F.col("value"), _STOPS, "none").alias("c"))


@query("PRJ10_per_capita", "SELECT n_nationkey, round(count(c_custkey) * 1000.0 / CASE WHEN n_nationkey % 3 = 0 THEN 10000 ELSE 5000 + n_nationkey END, 6) AS rate FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def per_capita(s, d):
    counts = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    people = table(s, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 != 0, 5000 + F.col("n_nationkey")).alias("population"))
    rate = F.coalesce("n", F.lit(0)) * 1000 / F.coalesce("population", F.lit(10000))
    return people.join(counts, "n_nationkey", "left").select("n_nationkey", F.round(rate, 6).alias("rate"))
