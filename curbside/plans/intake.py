"""Registered readers of raw exports and the remaining extension points (SRC, UDF, UDAF, MTH15)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from curbside.functions.geo import mercator_x, mercator_y
from curbside.operators import aggregates as agg
from curbside.operators.vector_tiles import decoded_points, encoded_tiles
from curbside.plans.registry import query
from curbside.plans.relational import LT, PT
from curbside.sources import files
from curbside.sources.paths import work_folder
from curbside.sources.tables import line_tickets, points, table

#: Tiny rows to try things on: ticket, date, time, code, description, fine, address, street, lon, lat.
def _archive() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("parking_tags_b.csv", "tag,fine\nB1,40\n".encode("utf-16"))
        archive.writestr("parking_tags_a.csv", "tag,fine\nA1,30\nA2,\"1,050\"\n")
        archive.writestr("notes.csv", "tag\nN1\n")
    return out.getvalue()


@query("SRC05_archive_rows", "SELECT * FROM (VALUES ('parking_tags_a.csv', 'a1'), ('parking_tags_a.csv', 'a2'), ('parking_tags_b.csv', 'b1')) t(member, tag)")
def archive_rows(s, d):
    """Members of an archive in two encodings; those with another name stay out."""
    lines = files.archive_rows(s.createDataFrame([("a.zip", _archive())], "path string, content binary"))
    return files.archive_table(lines).select("member", F.lower(F.col("cells")["tag"]).alias("tag"))


@query("SRC06_encodings", "SELECT * FROM (VALUES (0, 'UTF-16LE'), (1, 'UTF-16BE'), (2, 'UTF-8'), (3, 'UTF-16LE'), (4, 'UTF-8'), (5, 'UTF-8')) t(path, encoding)")
def encodings(s, d):
    heads = [b"\xff\xfea\x00", b"\xfe\xff\x00a", b"\xef\xbb\xbfa", b"a\x00b\x00", b"abcd", b""]
    found = files.encodings(s.createDataFrame([(str(k), h) for k, h in enumerate(heads)], "path string, content binary"))
    return found.select(F.col("path").cast("int").alias("path"), "encoding")


@query("SRC08_typed_or_empty", "SELECT r_regionkey, r_name FROM region")
def typed_or_empty(s, d):
    path, schema = work_folder(s, "typed"), "r_regionkey int, r_name string"
    table(s, d, "region").select("r_regionkey", "r_name").write.option("header", True).csv(path)
    return files.typed_or_empty(s, path, schema).unionByName(files.typed_or_empty(s, f"{path}-none", schema))


@query("SRC10_pruned_csv", "SELECT p_partkey, CAST(p_size AS INT) AS p_size FROM part")
def pruned_csv(s, d):
    """Two columns of a file with more, and with lines that do not fit the schema."""
    path = work_folder(s, "pruned")
    rows = table(s, d, "part").select(F.concat_ws(",", "p_partkey", F.concat(F.lit('"'), "p_name", F.lit('"')), "p_size").alias("value"))
    bad = s.createDataFrame([("not a number,x,y,z,too many",)], "value string")
    rows.unionByName(bad).write.text(path)
    schema = "p_partkey bigint, p_name string, p_size int"
    return s.read.schema(schema).option("mode", "DROPMALFORMED").csv(path).filter("p_partkey IS NOT NULL").select("p_partkey", "p_size")


@query("SRC11_preferred_files", "SELECT * FROM (VALUES ('2010/a_fixed.csv'), ('2011/b.csv'), ('2011/c.csv')) t(name)")
def preferred_files(s, d):
    names = files.preferred_files(["2011/c.csv", "2010/a.csv", "2010/a_fixed.csv", "2011/b.csv", "2011/readme.txt"])
    return s.createDataFrame([(n,) for n in names], "name string")


@query("SRC13_joined_quotes", "SELECT n_nationkey AS path, CAST(1 + 3 * i AS BIGINT) AS line_number, concat('\"', n_name, chr(10), i, '\"') AS record FROM nation, range(4) r(i) UNION ALL SELECT n_nationkey, CAST(3 + 3 * i AS BIGINT), 'plain' FROM nation, range(4) r(i)")
def joined_quotes(s, d):
    """Each record but the plain ones stands on two lines; buckets of five lines cut through some of them."""
    part = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")
    rows = table(s, d, "nation").select(F.col("n_nationkey").alias("path"), "n_name", part)
    lines = F.array(F.concat(F.lit('"'), "n_name"), F.concat(F.col("i").cast("string"), F.lit('"')), F.lit("plain"))
    lines = rows.select("path", "i", F.posexplode(lines).alias("k", "line")).select("path", (1 + 3 * F.col("i") + F.col("k")).cast("bigint").alias("line_number"), "line")
    return files.joined_quotes(lines, 5)


@query("SRC15_year_sheet", "SELECT n_name AS site, CAST(2 * sum(n_nationkey + y) AS DOUBLE) AS total FROM nation, (VALUES (2019), (2020)) v(y) GROUP BY 1")
def year_sheet(s, d):
    """A sheet with a header after four lines and one column a year; each site stands in two rows."""
    n = table(s, d, "nation")
    cells = n.select((6 + F.col("n_nationkey")).alias("line_number"), F.concat_ws(",", "n_name", F.col("n_nationkey") + 2019, F.col("n_nationkey") + 2020).alias("line"))
    head = s.createDataFrame([(k, "report") for k in range(1, 5)] + [(5, "site,2019,2020")], "line_number int, line string")
    sheet = head.unionByName(cells).unionByName(cells.withColumn("line_number", F.col("line_number") + 1000))
    lines = sheet.select(F.lit("sheet").alias("path"), F.lit("1").alias("member"), F.col("line_number").cast("bigint").alias("line_number"), "line")
    wide = files.wide_sheet(lines, 4).select(F.col("cells")["site"].alias("site"), *[F.col("cells")[y].alias(y) for y in ("2019", "2020")])
    long = files.wide_to_long(wide, ["site"], ["2019", "2020"], "year", "n")
    return files.site_maps(long, "site", "year", "n").select("site", "total")


@query("SRC25_seed_rows", "SELECT concat('SEED-', n_nationkey) AS ticket_number, CAST(30 + 10 * n_nationkey AS BIGINT) AS fine, concat(upper(n_name), ' ST') AS street FROM nation ORDER BY n_nationkey LIMIT 3")
def seed_rows(s, d):
    """A few tickets to begin with, the same each time: one for each of the first three nations."""
    first = table(s, d, "nation").orderBy("n_nationkey").limit(3)
    return first.select(F.concat(F.lit("SEED-"), F.col("n_nationkey").cast("string")).alias("ticket_number"), (30 + 10 * F.col("n_nationkey")).cast("bigint").alias("fine"), F.concat(F.upper("n_name"), F.lit(" ST")).alias("street"))


@query("UDF05_hooks", LT + "SELECT 'Code ' || code || ' costs ' || fine AS prompt, count(*) AS n FROM line_tickets WHERE fine < 2000 GROUP BY 1")
def hooks(s, d, keep="fine < 2000", prompt="Code {code} costs {fine}"):
    """A caller's own predicate and template."""
    from curbside.operators.corpus import records

    rows = records(line_tickets(s, d), prompt, "{ticket_number}", keep=F.expr(keep), required=["code"])
    return rows.groupBy("prompt").agg(F.count("*").alias("n"))


def order_years(s, d, least: int = 0):
    """A dataset handler: a function of session and folder, named as module:function."""
    return table(s, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n")).filter(F.col("year") >= least)


@query("UDF06_handlers", "SELECT 'curbside.plans.intake:order_years' AS handler, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1995 GROUP BY 2")
def handlers(s, d):
    """Datasets name their handlers as module:function in a table; each is looked up, imported and called with its options."""
    from curbside.plans.registry import handler

    named = s.createDataFrame([("orders", "curbside.plans.intake:order_years", 1995)], "dataset string, handler string, least int")
    made = [handler(r["handler"])(s, d, least=r["least"]).withColumn("handler", F.lit(r["handler"])) for r in named.collect()]  # a list that somebody wrote
    return made[0].select("handler", "year", "n")


_M = "lon * (20037508.342789244 / 180)", "ln(tan(radians(lat) / 2 + pi() / 4)) * (20037508.342789244 / pi())"


@query("UDAF01_cluster_reduce", PT + f"SELECT CAST(floor({_M[0]} / 1000) AS BIGINT) AS cell_x, CAST(floor({_M[1]} / 1000) AS BIGINT) AS cell_y, count(*) AS cluster_size, CAST(sum(amount) AS DECIMAL(28,2)) AS amount FROM points GROUP BY ALL")
def cluster_reduce(s, d):
    """Map to count and amount, reduce by cell, in two levels: cells of 250 m add up to those of 1000 m."""
    m = points(s, d).withColumns({"mx": mercator_x(F.col("lon")), "my": mercator_y(F.col("lat"))})
    fine = agg.grid_clusters(m, [250])
    coarse = fine.groupBy(F.floor(F.col("cell_x") / 4).alias("cell_x"), F.floor(F.col("cell_y") / 4).alias("cell_y"))
    return coarse.agg(F.sum("cluster_size").alias("cluster_size"), F.sum("amount").cast("decimal(28,2)").alias("amount"))


@query("UDAF01_radius_clusters")
def radius_clusters(s, d):
    """Clusters of all points within 2,000 m, and of those within 4,000 m; compared with a plain version in the tests."""
    from curbside.operators.radius_clusters import zoomed

    p = points(s, d).select(F.col("point_key").alias("key"), mercator_x(F.col("lon")).alias("x"), mercator_y(F.col("lat")).alias("y"), F.lit(1).cast("long").alias("n"), F.col("amount").cast("decimal(28,2)").alias("amount"))
    return zoomed(p, [0, 1], 4000.0).select("zoom", "key", "n", F.col("amount").cast("decimal(28,2)").alias("amount"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("MTH15_tile_points", PT + "SELECT CAST(floor((lon + 180) / 360 * 8192) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 8192) AS BIGINT) AS y, count(*) AS n FROM points GROUP BY ALL")
def tile_points(s, d):
    """Points in each vector tile, counted after reading its bytes back."""
    from curbside.operators.tiles import covering

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"x": frame["x"], "y": frame["y"], "n": [len(decoded_points(t)) for t in frame["mvt"]]})

    tiles = encoded_tiles(points(s, d), covering(points(s, d), [13]), 13, limit=1_000_000)
    return tiles.select("x", "y", "mvt").mapInPandas(count, "x long, y long, n long")
