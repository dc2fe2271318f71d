"""Registered readers, writers, table functions and streaming jobs (SRC, SNK, UDF, UDTF, UDAF, STR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from curbside.functions import geo
from curbside.operators import result_mart, writers
from curbside.operators.line_tiles import LINE, POLYGON, shape_tiles
from curbside.operators.vector_tiles import encoded_tiles
from curbside.plans.registry import query
from curbside.plans.relational import LT, PT, ST, TG
from curbside.sources import files
from curbside.sources.paths import work_folder
from curbside.sources.tables import LINE_TICKETS_SQL, POINTS_SQL, SITES_SQL, addresses, line_tickets, points, sites, streets, table, tags
from curbside.streaming import incremental, tile_queue, windows


# Readers.
@query("SRC03_paged_rows", "SELECT range AS row_id, range * 3 AS v FROM range(12500)")
def paged_rows(s, d):
    """A service of 12,500 rows in pages of 5,000, each page fetched by a task."""
    source = files.PagedSource(lambda offset, limit, where: [{"row_id": k, "v": 3 * k} for k in range(offset, min(offset + limit, 12_500))], "row_id long, v long")
    return source.read(s, 12_500)


@query("SRC04_filtered_pages", "SELECT range AS row_id FROM range(9000) WHERE range % 2 = 0")
def filtered_pages(s, d):
    """The filter goes to the service with every page."""

    def fetch(offset, limit, where):
        return [{"row_id": k} for k in range(offset, min(offset + limit, 9000)) if where is None or k % 2 == 0]

    return files.PagedSource(fetch, "row_id long", 2000).read(s, 9000, where="even")


@query("SRC07_csv_round_trip", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def csv_round_trip(s, d):
    path = work_folder(s, "csv")
    table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).option("compression", "gzip").csv(path)
    return files.csv_files(s, path, "c_custkey bigint, c_name string, c_mktsegment string")


@query("SRC09_merged_files", "SELECT p_partkey, p_name, CAST(NULL AS INT) AS p_size FROM part WHERE p_partkey < 50 UNION ALL SELECT p_partkey, NULL, p_size FROM part WHERE p_partkey >= 50")
def merged_files(s, d):
    p = table(s, d, "part")
    return files.merged([p.filter("p_partkey < 50").select("p_partkey", "p_name"), p.filter("p_partkey >= 50").select("p_partkey", "p_size")])


@query("SRC14_wide_to_long", LT + "SELECT site_key, sum(n)::DOUBLE AS total FROM (SELECT site_key, year, count(*) AS n FROM line_tickets WHERE year BETWEEN 1994 AND 1997 GROUP BY ALL) GROUP BY 1")
def wide_to_long(s, d):
    """A sheet with one column a year, back to one row for each site."""
    years = [1994, 1995, 1996, 1997]
    wide = line_tickets(s, d).filter(F.col("year").isin(years)).groupBy("site_key").pivot("year", years).count()
    return files.site_maps(files.wide_to_long(wide, ["site_key"], [str(y) for y in years], "year", "n"), "site_key", "year", "n").select("site_key", "total")


@query("SRC16_geojson", f"WITH {SITES_SQL} SELECT CAST(site_key AS BIGINT) AS site_key, ward FROM sites")
def geojson(s, d):
    path = work_folder(s, "geojson")
    writers.write_features(sites(s, d).select("site_key", "ward", "lon", "lat"), "site_key", path)
    return files.geojson_lines(s, path, "site_key: bigint, ward: string").select("site_key", "ward")


@query("SRC17_last_wins", "SELECT upper(p_name) AS lookup_key, arg_max(p_brand, p_partkey) AS p_brand FROM part GROUP BY 1")
def last_wins(s, d):
    return files.lookup(table(s, d, "part").select("p_partkey", "p_name", "p_brand"), F.upper("p_name"), False, "p_partkey").select("lookup_key", "p_brand")


@query("SRC18_first_wins", "SELECT upper(p_name) AS lookup_key, arg_min(p_brand, p_partkey) AS p_brand FROM part GROUP BY 1")
def first_wins(s, d):
    return files.lookup(table(s, d, "part").select("p_partkey", "p_name", "p_brand"), F.upper("p_name"), True, "p_partkey").select("lookup_key", "p_brand")


@query("SRC19_json_dict", "SELECT n_name AS k, CAST(n_nationkey AS BIGINT) AS v FROM nation")
def json_dict(s, d):
    text = table(s, d, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey")))).alias("j"))
    return text.select(F.explode(F.from_json("j", "map<string,bigint>")).alias("k", "v"))


@query("SRC21_inline_values", "SELECT * FROM (VALUES (8, 1000), (10, 500), (12, 250)) t(z, g)")
def inline_values(s, d):
    return s.sql("SELECT * FROM VALUES (8, 1000), (10, 500), (12, 250) AS t(z, g)")


@query("SRC22_series", "SELECT CAST(range AS BIGINT) AS z FROM range(3, 17)")
def series(s, d):
    return s.range(3, 17).select(F.col("id").alias("z"))


@query("SRC23_parallel_arrays", "SELECT n_nationkey, CAST(i - 1 AS INT) AS pos, [10, 20, 30][i] AS a, ['x', 'y', 'z'][i] AS b FROM nation, range(1, 4) r(i)")
def parallel_arrays(s, d):
    zipped = F.arrays_zip(F.array(*map(F.lit, (10, 20, 30))).alias("a"), F.array(*map(F.lit, ("x", "y", "z"))).alias("b"))
    return table(s, d, "nation").select("n_nationkey", F.posexplode(zipped).alias("pos", "t")).select("n_nationkey", "pos", "t.a", "t.b")


# Writers.
def _halves(s, d):
    p = table(s, d, "part").select("p_partkey", "p_name", "p_size")
    old = p.filter("p_partkey % 3 <> 0")
    new = p.filter("p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.upper("p_name")).alias("p_name"), (F.col("p_size") + 100).alias("p_size"))
    return old, new


_UPSERT = "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 4 <> 0 THEN upper(p_name) WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN NULL ELSE p_name END AS p_name, CASE WHEN p_partkey % 2 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0"


@query("SNK01_append", "SELECT n_nationkey FROM nation UNION ALL SELECT n_nationkey FROM nation")
def append(s, d):
    path = work_folder(s, "append")
    for _ in range(2):
        writers.append(table(s, d, "nation").select("n_nationkey"), path)
    return s.read.parquet(path)


@query("SNK02_refresh", "SELECT r_regionkey, r_name FROM region")
def refresh(s, d):
    path = work_folder(s, "refresh")
    writers.refresh(table(s, d, "region").limit(1), path)
    writers.refresh(table(s, d, "region").select("r_regionkey", "r_name"), path)
    return s.read.parquet(path)


@query("SNK03_upsert", _UPSERT)
def upsert(s, d):
    old, new = _halves(s, d)
    return writers.upserted(old, writers.latest(new, ["p_partkey"], [F.desc("p_size")]), ["p_partkey"], ["p_name"])


@query("SNK04_replace_partitions", LT + "SELECT year, count(*) AS n, CAST(sum(CASE WHEN year = 1996 THEN 0 ELSE fine END) AS DECIMAL(28,2)) AS fines FROM line_tickets WHERE year IN (1995, 1996, 1997) GROUP BY year")
def replace_partitions(s, d):
    path = work_folder(s, "partitions")
    t = line_tickets(s, d).select("ticket_number", "fine", "year").filter("year IN (1995, 1996, 1997)")
    writers.refresh(t, path, "year")
    writers.replace_partitions(t.filter("year = 1996").withColumn("fine", F.lit(0).cast("decimal(18,2)")), path, "year")
    return s.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"), F.sum("fine").cast("decimal(28,2)").alias("fines"))


@query("SNK05_camera_upsert", f"WITH {SITES_SQL} SELECT ward_code, arg_min(site_key, (-balance, site_key)) AS site_key FROM sites GROUP BY 1")
def camera_upsert(s, d):
    """Of several rows of an intersection the one with most tickets enters; written twice, nothing changes."""
    rows = writers.latest(sites(s, d).select("ward_code", "site_key", "balance"), ["ward_code"], [F.desc("balance"), "site_key"])
    return writers.upserted(rows, rows, ["ward_code"]).select("ward_code", "site_key")


@query(
    "SNK06_charge_upsert",
    f"""WITH {LINE_TICKETS_SQL}, {SITES_SQL}, c AS (SELECT site_key, year, count(*) AS n FROM line_tickets GROUP BY ALL), last AS (SELECT max(year) AS y FROM c)
    SELECT site_key, year, CASE WHEN year = y THEN n ELSE n + 1 END AS n, round(lon, 6) AS lon FROM c CROSS JOIN last LEFT JOIN sites USING (site_key)""",
)
def charge_upsert(s, d):
    """Charges of a site and year take the place of their camera; those of the last year replace what was loaded before,
    those of years before stay as they were loaded."""
    charges = line_tickets(s, d).groupBy("site_key", "year").agg(F.count("*").alias("n"))
    placed = charges.join(sites(s, d).select("site_key", F.round("lon", 6).alias("lon")), "site_key", "left")
    last = placed.agg(F.max("year").alias("y"))  # one row
    marked = placed.crossJoin(F.broadcast(last))
    loaded = marked.withColumn("n", F.col("n") + 1).select("site_key", "year", "n", "lon")
    return writers.upserted(loaded, marked.filter("year = y").select("site_key", "year", "n", "lon"), ["site_key", "year"])


@query("SNK08_update_from", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 4 <> 0 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_partkey % 2 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part WHERE p_partkey % 3 <> 0")
def update_from(s, d):
    old, new = _halves(s, d)
    return writers.updated(old, new, "p_partkey", ["p_name", "p_size"])


@query("SNK09_backfill", f"WITH {POINTS_SQL} SELECT point_key, round(lon, 6) AS lon FROM points")
def backfill(s, d):
    p = points(s, d).select("point_key", F.round("lon", 6).alias("lon"))
    holes = p.withColumn("lon", F.when(F.col("point_key") % 3 != 0, F.col("lon")))
    return writers.backfilled(holes, p, "point_key", ["lon"])


@query("SNK11_swap_in", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 5")
def swap_in(s, d):
    path = work_folder(s, "swap")
    writers.refresh(table(s, d, "nation"), path)
    writers.swap_in(s, s.read.parquet(path).filter("n_nationkey >= 5").select("n_nationkey", "n_name"), path)
    return s.read.parquet(path)


@query("SNK12_feature_document", f"WITH {SITES_SQL} SELECT 'FeatureCollection' AS kind, count(*) AS n FROM sites")
def feature_document(s, d):
    path = work_folder(s, "features")
    writers.write_features(sites(s, d).select("site_key", "ward", "lon", "lat"), "site_key", path)
    lines = s.read.text(path)
    n = lines.filter("value LIKE '%\"type\":\"Feature\"%'").agg(F.count("*").alias("n"))
    return lines.filter("value LIKE '%FeatureCollection%'").select(F.get_json_object(F.concat("value", F.lit("]}")), "$.type").alias("kind")).crossJoin(F.broadcast(n))


@query("SNK13_chat_lines", LT + "SELECT '{\"messages\":[{\"role\":\"user\",\"content\":\"Fine of ' || description || '?\"},{\"role\":\"assistant\",\"content\":\"' || n || '\"}]}' AS value FROM (SELECT description, count(*) AS n FROM line_tickets GROUP BY 1)")
def chat_lines(s, d):
    from curbside.operators.corpus import chat_lines as lines
    from curbside.operators.corpus import records

    rows = line_tickets(s, d).groupBy("description").agg(F.count("*").alias("n"))
    return lines(records(rows, "Fine of {description}?", "{n}", required=["description"]))


@query("SNK14_report", "SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def report(s, d):
    path = work_folder(s, "report")
    table(s, d, "part").groupBy("p_type").agg(F.count("*").alias("n")).coalesce(1).write.option("header", True).csv(path)
    return s.read.option("header", True).schema("p_type string, n bigint").csv(path)


@query("SNK16_chunk_manifest", "SELECT c_mktsegment AS segment, count(*) AS n, lower(c_mktsegment) AS slug FROM customer GROUP BY 1")
def chunk_manifest(s, d):
    rows = table(s, d, "customer").select(F.col("c_mktsegment").alias("segment"), "c_custkey")
    return writers.chunk_manifest(writers.payload_manifest(rows, "segment"), "segment").select("segment", "n", "slug")


@query("SNK18_tile_archive", PT + "SELECT count(*) AS n, count(DISTINCT (CAST(floor((lon + 180) / 360 * 4096) AS BIGINT), CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096) AS BIGINT))) AS tiles FROM points")
def tile_archive(s, d):
    from curbside.operators.tiles import write_tiles

    path = work_folder(s, "tiles")
    write_tiles(points(s, d), 12, path)
    return s.read.parquet(path).agg(F.count("*").alias("n"), F.count_distinct("quadkey").alias("tiles"))


# Table functions.
@query("UDF01_quadkey_prefix", PT + "SELECT point_key, array_to_string(list_transform(range(15, 9, -1), lambda k: (CAST(floor((lon + 180) / 360 * 65536) AS BIGINT) >> k) % 2 + 2 * ((CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 65536) AS BIGINT) >> k) % 2)), '') AS prefix FROM points")
def quadkey_prefix(s, d, zoom=16, length=6):
    key = geo.quadkey(geo.tile_x(F.col("lon"), zoom), geo.tile_y(F.col("lat"), zoom), zoom)
    return points(s, d).select("point_key", F.left(key, F.lit(length)).alias("prefix"))


@query("UDF02_tile_envelope", "SELECT x, y, round(x * 40075016.685578488 / 16 - 20037508.342789244, 3) AS xmin, round(20037508.342789244 - y * 40075016.685578488 / 16, 3) AS ymax FROM range(16) a(x), range(16) b(y)")
def tile_envelope(s, d):
    grid = s.range(16).select(F.col("id").alias("x")).crossJoin(F.broadcast(s.range(16).select(F.col("id").alias("y"))))
    box = geo.tile_envelope(F.lit(4), F.col("x"), F.col("y"))
    return grid.select("x", "y", F.round(box["xmin"], 3).alias("xmin"), F.round(box["ymax"], 3).alias("ymax"))


_TILES_14 = PT + "SELECT CAST(floor((lon + 180) / 360 * 16384) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384) AS BIGINT) AS y, CAST(count(*) AS INT) AS n_features FROM points GROUP BY ALL"


@query("UDTF01_parking_tiles", _TILES_14)
def parking_tiles(s, d):
    """Tiles of points as vector tiles; the bytes themselves are checked by decoding in the tests."""
    from curbside.operators.tiles import covering

    return encoded_tiles(points(s, d), covering(points(s, d), [14]), 14).select("x", "y", "n_features")


@query("UDTF01_tiles_from_sql", _TILES_14)
def tiles_from_sql(s, d):
    """The same tiles by the table function, called from SQL."""
    from curbside.operators.tile_functions import placed_features, register
    from curbside.operators.tiles import covering

    register(s)
    features = placed_features(points(s, d), covering(points(s, d), [14]), 14)
    return s.sql("SELECT x, y, n_features FROM vector_tile(TABLE({features}) PARTITION BY (z, x, y) ORDER BY (px, py, n, amount))", features=features)


@query("UDTF02_camera_tiles", ST + "SELECT CAST(floor((lon + 180) / 360 * 8192) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 8192) AS BIGINT) AS y, CAST(count(*) AS INT) AS n_features FROM sites GROUP BY ALL")
def camera_tiles(s, d):
    from curbside.operators.tiles import covering

    p = sites(s, d).select(F.col("site_key").alias("point_key"), "lon", "lat", F.col("balance").alias("amount"))
    return encoded_tiles(p, covering(p, [13]), 13, "cameras").select("x", "y", "n_features")


def glow_lines(s, d):
    """A winding line of nine corners through each site: layer, kind, id, n, parts."""
    k, key = F.sequence(F.lit(0), F.lit(8)), F.col("site_key")
    corner = lambda i: F.struct((F.col("lon") + i * 0.0015 * (1 + key % 3)).alias("lon"), (F.col("lat") + (key * i * 7 % 5) * 0.0004).alias("lat"))
    return sites(s, d).select(F.lit("glow_lines").alias("layer"), F.lit(LINE).alias("kind"), key.alias("id"), (key % 50).alias("n"), F.array(F.transform(k, corner)).alias("parts"))


@query("UDF03_glow_lines")
def glow_tiles(s, d, zoom=12):
    """The tiles that sites lie in, with all lines that reach them, thinned for the zoom; compared with a plain version in the tests."""
    asked = sites(s, d).select(geo.tile_x(F.col("lon"), zoom).alias("x"), geo.tile_y(F.col("lat"), zoom).alias("y"))
    return shape_tiles(glow_lines(s, d), zoom, 32, True, asked).select("x", "y", "n_features", F.sha2("mvt", 256).alias("mvt_sha256"))


@query(
    "UDF04_geocoded",
    """SELECT DISTINCT concat('NR ', c_custkey % 300, 'B Queen St E') AS address, CASE WHEN c_custkey % 300 <= 98 THEN 'range' ELSE 'nearest_range' END AS method, CASE WHEN c_custkey % 300 <= 98 THEN 3 ELSE 4 END AS segment_id, -79.36::DOUBLE AS lon, 43.65::DOUBLE AS lat
    FROM customer WHERE c_custkey % 8 = 2 UNION ALL SELECT DISTINCT concat(c_custkey % 90, '-12 king street w'), 'range', 7, -79.39, 43.64 FROM customer WHERE c_custkey % 8 = 1
    UNION ALL SELECT concat(' ', c_custkey, ' Main  Street NB'), CASE WHEN c_custkey <= 5000 THEN 'range' ELSE 'nearest_range' END, CASE WHEN c_custkey <= 5000 THEN 1 ELSE 2 END, -79.4, 43.7 FROM customer WHERE c_custkey % 8 = 0
    UNION ALL SELECT DISTINCT 'Yonge St & Bloor Street West', 'intersection', 5, -79.385, 43.665 FROM customer WHERE c_custkey % 8 = 3""",
)
def geocoded(s, d):
    """Addresses on a small street network; those that cannot be placed are left out."""
    from curbside.operators.geocode import geocoded as geocode

    return geocode(addresses(s, d), streets(s)).select("address", "method", "segment_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


_STEP = "SELECT x.*, {1} + coalesce(diff, 1) AS {0} FROM {2} x LEFT JOIN r ON previous = {1} % 10"


@query(
    "UDF07_predicted_next",
    TG + """, p AS (SELECT number, lag(number) OVER (ORDER BY tag) AS prev FROM tags), g AS (SELECT prev % 10 AS previous, number - prev AS diff, count(*) AS n FROM p WHERE prev IS NOT NULL GROUP BY ALL),
    r AS (SELECT previous, diff FROM (SELECT *, row_number() OVER (PARTITION BY previous ORDER BY n DESC, diff) AS rn FROM g) WHERE rn = 1), l AS (SELECT officer, arg_max(number, tag) AS number FROM tags GROUP BY 1),
    """
    + f"s1 AS ({_STEP.format('a', 'number', 'l')}), s2 AS ({_STEP.format('b', 'a', 's1')}), s3 AS ({_STEP.format('c', 'b', 's2')}) SELECT officer, number, concat_ws(',', a, b, c) AS predicted FROM s3",
)
def predicted_next(s, d):
    from curbside.operators.patterns import predicted_next as predict

    return predict(tags(s, d)).select("officer", "number", F.array_join(F.transform("predicted", lambda x: x.cast("string")), ",").alias("predicted"))


@query("UDF08_monitoring_list", TG + "SELECT CAST(number // 100 AS BIGINT) AS batch, 100 - count(*) AS missing, max(number) + 1 AS next_number, round(100.0 * count(*) / 100, 2) AS used_percent FROM tags GROUP BY 1 HAVING count(*) < 100 ORDER BY used_percent DESC, batch LIMIT 20")
def monitoring_list(s, d):
    from curbside.operators.patterns import monitoring_list as watch

    return watch(tags(s, d)).select("batch", "missing", "next_number", "used_percent")


# Streaming jobs. Streams read the same files as tables do; the batch form of each has its SQL.
@query("STR10_tumbling", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM events GROUP BY ALL")
def tumbling(s, d):
    out = windows.tumbling(table(s, d, "events"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("STR10_sliding", "SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 10 MINUTE, ts), time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 10 MINUTE, time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 20 MINUTE]) AS w FROM events) GROUP BY 1")
def sliding(s, d):
    return windows.sliding(table(s, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("STR11_sessions", "SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS session_start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, k")
def sessions(s, d):
    return windows.sessions(table(s, d, "events")).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("STR10_tumbling_stream")
def tumbling_stream(s, d):
    """The same windows from a stream with late data; those still open at its end are not emitted yet."""
    source, target = f"{d}/events.parquet*", work_folder(s, "windows")
    stream = s.readStream.schema(table(s, d, "events").schema).parquet(source)
    windows.tumbling(stream).writeStream.format("parquet").option("path", f"{target}/out").option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{target}/out")


@query("STR12_without_repeats", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def without_repeats(s, d):
    """A stream in which every event comes twice; each passes once. State is held as long as events may be late."""
    target = work_folder(s, "repeats")
    stream = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("ts", F.col("ts").cast("timestamp"))
    once = windows.without_repeats(twice, ["event_id"])
    once.writeStream.format("parquet").option("path", f"{target}/out").option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{target}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query("STR01_tile_queue", PT + "SELECT CASE WHEN x % 3 <> 0 THEN 'done' ELSE 'dead' END AS outcome, CASE WHEN x % 3 <> 0 THEN 4 ELSE 5 END AS attempt, count(*) AS n FROM (SELECT DISTINCT CAST(floor((lon + 180) / 360 * 4096) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096) AS BIGINT) AS y FROM points) GROUP BY 1, 2")
def queue(s, d):
    """Requests for tiles, some of which fail until they are given up: outcomes after all tries. The second run comes before
    the retries are due and does nothing, the third one after."""
    base = work_folder(s, "queue")
    from curbside.operators.tiles import covering

    asked = covering(points(s, d), [12]).select(F.lit("parking").alias("dataset"), F.lit("s0").alias("shard"), F.col("z").cast("int").alias("z"), "x", "y", F.lit(tile_queue.MOST_ATTEMPTS - 1).alias("attempt"), F.lit(0).cast("bigint").alias("not_before"))
    asked.write.parquet(f"{base}/in")
    render = lambda r: r.select("dataset", "z", "x", "y", (F.pmod("x", F.lit(3)) != 0).alias("ok"))
    for now in (1000, 1001, 2000):
        tile_queue.run_queue(s, f"{base}/in", render, f"{base}/done", f"{base}/dead", f"{base}/state", F.lit(now)).awaitTermination()
    done = s.read.parquet(f"{base}/done").select(F.lit("done").alias("outcome"), "attempt")
    return done.union(s.read.parquet(f"{base}/dead").select(F.lit("dead"), "attempt")).groupBy("outcome", "attempt").agg(F.count("*").alias("n"))


@query("STR02_outcomes", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'done' WHEN o_orderkey % 6 + 1 >= 5 THEN 'dead' ELSE 'retry' END AS outcome, count(*) AS n, sum(CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 6 + 1 >= 5 THEN 0 ELSE least(300, 2 * 2 ** (o_orderkey % 6)) END)::DOUBLE AS wait FROM orders GROUP BY 1")
def outcomes(s, d):
    k = F.col("o_orderkey")
    requests = table(s, d, "orders").select(F.lit("a").alias("dataset"), F.lit(9).alias("z"), k.alias("x"), F.lit(0).cast("bigint").alias("y"), (k % 6 + 1).cast("int").alias("attempt"))
    rendered = requests.select("dataset", "z", "x", "y", (F.col("x") % 3 == 0).alias("ok"))
    return tile_queue.outcomes(requests, rendered).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("wait_seconds").alias("wait"))


@query("STR04_changed_resources", "SELECT 'r' || n_nationkey AS slug FROM nation WHERE n_nationkey % 4 = 0 OR n_nationkey >= 20")
def changed_resources(s, d):
    n = table(s, d, "nation")
    slug = F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("slug")
    manifest = n.select(slug, F.lit("2024-01-01").alias("last_modified"), F.sha1(F.when(F.col("n_nationkey") % 4 == 0, "new").otherwise("same")).alias("sha1"))
    state = n.filter("n_nationkey < 20").select(slug, F.lit("2024-01-01").alias("last_modified"), F.sha1(F.lit("same")).alias("sha1"))
    return incremental.changed(manifest, state).select("slug")


@query("STR05_state_digest", "SELECT sha1(string_agg('r' || n_nationkey || ':' || md5(n_name), '|' ORDER BY 'r' || n_nationkey || ':' || md5(n_name))) AS digest FROM nation")
def state_digest(s, d):
    return incremental.state_digest(table(s, d, "nation").select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("slug"), F.md5("n_name").alias("sha1")))


@query("STR06_needs_rebuild", "SELECT n_name AS slug FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 7 = 0")
def needs_rebuild(s, d):
    n = table(s, d, "nation")
    manifest = n.select(F.col("n_name").alias("slug"), F.sha1("n_name").alias("sha1"))
    state = n.select(F.col("n_name").alias("slug"), F.when(F.col("n_nationkey") % 5 == 0, "old").otherwise(F.sha1("n_name")).alias("sha1"), F.when(F.col("n_nationkey") % 7 == 0, 1).otherwise(2).alias("schema_version"))
    return incremental.needs_rebuild(manifest, state, 2)


@query("STR07_loaded_by_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def loaded_by_stream(s, d):
    base = work_folder(s, "load")
    schema = ", ".join(f"{c} {t}" for c, t in table(s, d, "events").dtypes)
    for _ in range(2):  # the second run finds nothing new
        incremental.load_new_files(s, f"{d}/events.parquet*", schema, f"{base}/out", f"{base}/state").awaitTermination()
    return s.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query("STR03_progress", "SELECT 'parking' AS dataset, CAST(o_orderkey % 4 AS VARCHAR) AS shard, count(*) AS finished FROM orders GROUP BY 2")
def shard_progress(s, d):
    """Finished tiles by shard with stateful counters."""
    base = work_folder(s, "progress")
    rows = table(s, d, "orders").select(F.lit("parking").alias("dataset"), (F.col("o_orderkey") % 4).cast("string").alias("shard"))
    rows.repartition(4).write.parquet(f"{base}/in")
    stream = s.readStream.schema("dataset string, shard string").option("maxFilesPerTrigger", 2).parquet(f"{base}/in")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    tile_queue.progress(stream, 10**9, 1000).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{base}/out").groupBy("dataset", "shard").agg(F.max("finished").alias("finished"))


@query("SRC12_listed_exports", "SELECT * FROM (VALUES (0, 'a/2010.csv'), (1, 'b/part.001'), (2, 'b/part.002')) t(position, name)")
def listed_exports(s, d):
    names = files.ticket_files(["a/2010.csv", "b/part.001", "readme.txt", "b/part.002", "a/2010.csv"])
    return s.createDataFrame(list(enumerate(names)), "position int, name string")


@query("SRC24_catalog", "SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) t(name, kind)")
def catalog(s, d):
    table(s, d, "nation").createOrReplaceTempView("catalog_nation")
    columns = s.catalog.listColumns("catalog_nation")
    return s.createDataFrame([(c.name, c.dataType) for c in columns], "name string, kind string")


@query("SNK07_centreline_upsert", "SELECT p_partkey, p_size + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS p_size FROM part")
def centreline_upsert(s, d):
    """One row for each id enters, the last of several."""
    old = table(s, d, "part").select("p_partkey", "p_size")
    new = old.filter("p_partkey % 2 = 0").select("p_partkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("v"), (F.col("p_size") + F.col("v")).alias("p_size"))
    return writers.upserted(old, writers.latest(new, ["p_partkey"], [F.desc("v")]).select("p_partkey", "p_size"), ["p_partkey"])


@query("SNK10_replace_dataset", "SELECT 'ase' AS dataset, n_nationkey AS ward_code, 2 AS n FROM nation UNION ALL SELECT 'red', n_nationkey, 1 FROM nation")
def replace_dataset(s, d):
    path = work_folder(s, "wards")
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("ward_code"))
    rows = lambda name, k: n.select("ward_code", F.lit(k).alias("n"), F.lit(name).alias("dataset"))
    writers.refresh(rows("ase", 1).unionByName(rows("red", 1)), path, "dataset")
    writers.replace_partitions(rows("ase", 2), path, "dataset")
    return s.read.parquet(path).select("dataset", "ward_code", "n")


@query("SNK15_payload_digest", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def payload_digest(s, d):
    """Payloads unpack to what their digests were taken of."""
    from curbside.functions.slow import unpacked

    rows = writers.payload_manifest(table(s, d, "customer").select(F.col("c_mktsegment").alias("segment"), "c_custkey"), "segment", 100)
    return rows.filter(F.sha2(unpacked(F.col("payload")), 256) == F.col("etag")).groupBy("segment").agg(F.sum("n").alias("n"))


@query("SNK17_merged_chunks", "SELECT c_custkey FROM customer")
def merged_chunks(s, d):
    path = work_folder(s, "chunks")
    table(s, d, "customer").select("c_custkey").repartitionByRange(4, "c_custkey").write.json(path)
    return files.json_lines(s, path, "c_custkey bigint")


_WARDS = "w AS (SELECT n_nationkey AS k, -79.6::DOUBLE + (n_nationkey % 5) * 0.1::DOUBLE AS x0, 43.58::DOUBLE + (n_nationkey // 5) * 0.05::DOUBLE AS y0 FROM nation)"
_ROW = "(1 - ln(tan(radians({0})) + 1 / cos(radians({0}))) / pi()) / 2 * (1 << z)"
_REACHED = f"""t AS (SELECT z, k, unnest(range(CAST(floor((x0 + 180) / 360 * (1 << z) - 1 / 64) AS BIGINT), CAST(floor((x0 + 0.1 + 180) / 360 * (1 << z) + 1 / 64) AS BIGINT) + 1)) AS x,
      CAST(floor({_ROW.format("(y0 + 0.05)")} - 1 / 64) AS BIGINT) AS low, CAST(floor({_ROW.format("y0")} + 1 / 64) AS BIGINT) AS high FROM w, (VALUES (9), (11), (12)) v(z)), r AS (SELECT z, k, x, unnest(range(low, high + 1)) AS y FROM t)"""


def ward_shapes(s, d):
    """A ward for each nation, with a hole, and its tickets: layer, kind, id, n, parts."""
    k = F.col("n_nationkey")
    placed = table(s, d, "nation").select(k.alias("id"), (F.lit(-79.6) + (k % 5) * 0.1).alias("x"), (F.lit(43.58) + F.floor(k / 5) * 0.05).alias("y"))

    def ring(x, y, w, h, back=False):
        corners = [F.struct((F.col("x") + a).alias("lon"), (F.col("y") + b).alias("lat")) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))]
        return F.array(*(corners[::-1] if back else corners))

    counted = sites(s, d).groupBy(F.col("ward_code").alias("id")).agg(F.count("*").alias("n"))
    shapes = placed.select(F.lit("wards").alias("layer"), F.lit(POLYGON).alias("kind"), "id", F.array(ring(0.0, 0.0, 0.1, 0.05), ring(0.03, 0.01, 0.03, 0.02, True)).alias("parts"))
    return shapes.join(counted, "id", "left").na.fill({"n": 0})


@query("MTH15_tile_shapes", f"WITH {_WARDS}, {_REACHED} SELECT x, y, CAST(count(*) AS INT) AS n_features FROM r WHERE z = 12 GROUP BY ALL")
def tile_shapes(s, d):
    """Polygons with holes in vector tiles, clipped with a margin of 64; what the tiles hold is compared in the tests."""
    return shape_tiles(ward_shapes(s, d), 12).select("x", "y", "n_features")


@query("SNK19_tile_pyramid", f"WITH {_WARDS}, {_REACHED} SELECT CAST(z AS INT) AS z, count(DISTINCT (x, y)) AS tiles, count(*) AS features FROM r WHERE z IN (9, 11) GROUP BY z")
def tile_pyramid(s, d):
    """Ward polygons at two zooms, written by z and read again."""
    path = work_folder(s, "pyramid")
    for zoom in (9, 11):
        shape_tiles(ward_shapes(s, d), zoom).write.mode("append").partitionBy("z").parquet(path)
    return s.read.parquet(path).groupBy("z").agg(F.count("*").alias("tiles"), F.sum("n_features").alias("features"))


@query("SNK20_tile_groups", PT + "SELECT array_to_string([(CAST(floor((lon + 180) / 360 * 4096) AS BIGINT) >> 11) % 2 + 2 * ((CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096) AS BIGINT) >> 11) % 2)], '') AS g, count(*) AS n FROM points GROUP BY 1")
def tile_groups(s, d):
    from curbside.operators.tiles import tiled

    return tiled(points(s, d), 12).groupBy(F.col("tile_group").alias("g")).agg(F.count("*").alias("n"))


def _result_mart(s, d):
    """Answers for the nations whose number is even; every third one is past its expiry, every fourth long so."""
    k = F.col("n_nationkey")
    expires = F.when(k % 4 == 0, 100).when(k % 3 == 0, 950).otherwise(2000).cast("bigint")
    return table(s, d, "nation").filter("n_nationkey % 2 = 0").select(k.cast("bigint").alias("key"), F.concat(F.lit("old "), "n_name").alias("value"), expires.alias("expires_at"), k.cast("bigint").alias("used_at"))


def _answers(s, d):
    requests = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("key"))
    compute = lambda keys: keys.join(table(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.concat(F.lit("new "), "n_name").alias("value")), "key")
    return result_mart.answered(requests, _result_mart(s, d), compute, F.lit(1000), 600, 120)


_OUTCOME = "CASE WHEN n_nationkey % 2 = 1 OR n_nationkey % 4 = 0 THEN 'missing' WHEN n_nationkey % 3 = 0 THEN 'stale' ELSE 'fresh' END"


@query("STR08_cached_answers", f"SELECT c_custkey, CASE WHEN {_OUTCOME} = 'missing' THEN 'new ' ELSE 'old ' END || n_name AS value, {_OUTCOME} AS outcome FROM customer JOIN nation ON n_nationkey = c_nationkey")
def cached_answers(s, d):
    """Requests served from a mart with expiry; stale answers serve once more while they are renewed."""
    return _answers(s, d)[0].select("c_custkey", "value", "outcome")


@query(
    "STR09_coalesced_requests",
    f"""SELECT n_nationkey::BIGINT AS key, CASE WHEN {_OUTCOME} = 'fresh' THEN 'old ' ELSE 'new ' END || n_name AS value, CASE WHEN {_OUTCOME} = 'fresh' THEN 2000 ELSE 1600 END::BIGINT AS expires_at, 1000::BIGINT AS used_at
    FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)
    UNION ALL SELECT n_nationkey, 'old ' || n_name, CASE WHEN n_nationkey % 3 = 0 THEN 950 ELSE 2000 END, n_nationkey FROM nation WHERE n_nationkey % 4 = 2 AND n_nationkey NOT IN (SELECT c_nationkey FROM customer)""",
)
def coalesced_requests(s, d):
    """The mart after the requests: each key was worked out once, however many asked for it."""
    return _answers(s, d)[1]
