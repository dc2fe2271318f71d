"""The library's concepts on the tables of a data folder: tickets, officers' events, camera sites, streets.

The same DataFrames stand behind every registered query; ``*_SQL`` hold their DuckDB counterparts, to be put in a WITH
clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets without their place: one row for each line item. Narrow, for queries that need no join."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ticket_number"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("site_key"),
        F.to_date("l_shipdate").alias("ticket_date"),
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("fine"),
        F.col("l_returnflag").alias("code"),
        F.concat("l_returnflag", "l_linestatus").alias("description"),
    )


LINE_TICKETS_SQL = """line_tickets AS (
  SELECT concat(l_orderkey, '-', l_linenumber) AS ticket_number, l_orderkey AS order_key, l_partkey AS part_key, l_suppkey AS site_key,
         CAST(l_shipdate AS DATE) AS ticket_date, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS fine, l_returnflag AS code, concat(l_returnflag, l_linestatus) AS description FROM lineitem)"""


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets with location (part name), street (part type) and code (brand)."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part_key"), F.col("p_name").alias("location"), F.col("p_type").alias("street"), F.col("p_brand").alias("brand")
    )
    return line_tickets(spark, sf_dir).join(part, "part_key")


TICKETS_SQL = LINE_TICKETS_SQL + """,
tickets AS (SELECT t.*, p_name AS location, p_type AS street, p_brand AS brand FROM line_tickets t JOIN part ON part_key = p_partkey)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera sites: suppliers with ward (nation), division (region) and a place on the map."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("site_key"), F.col("s_name").alias("site_name"), F.col("n_nationkey").alias("ward_code"), F.col("n_name").alias("ward"),
            F.col("r_name").alias("division"), F.col("s_acctbal").cast("decimal(18,2)").alias("balance"),
            (F.lit(-79.6) + (F.col("s_suppkey") * 37 % 500) / 1000.0).alias("lon"), (F.lit(43.58) + (F.col("s_suppkey") * 91 % 270) / 1000.0).alias("lat"),
        )
    )


SITES_SQL = """sites AS (
  SELECT s_suppkey AS site_key, s_name AS site_name, n_nationkey AS ward_code, n_name AS ward, r_name AS division, CAST(s_acctbal AS DECIMAL(18,2)) AS balance,
         -79.6::DOUBLE + (s_suppkey * 37 % 500) / 1000.0::DOUBLE AS lon, 43.58::DOUBLE + (s_suppkey * 91 % 270) / 1000.0::DOUBLE AS lat
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticketed places: customers with a place on the map."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("point_key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("area"),
        F.col("c_acctbal").cast("decimal(18,2)").alias("amount"),
        (F.lit(-79.6) + (F.col("c_custkey") * 7919 % 5000) / 10000.0).alias("lon"), (F.lit(43.58) + (F.col("c_custkey") * 104729 % 2700) / 10000.0).alias("lat"),
    )


POINTS_SQL = """points AS (
  SELECT c_custkey AS point_key, c_name AS name, c_mktsegment AS segment, c_nationkey AS area, CAST(c_acctbal AS DECIMAL(18,2)) AS amount,
         -79.6::DOUBLE + (c_custkey * 7919 % 5000) / 10000.0::DOUBLE AS lon, 43.58::DOUBLE + (c_custkey * 104729 % 2700) / 10000.0::DOUBLE AS lat FROM customer)"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issued tags in order: events with a time zone, an officer and a fine."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("tag"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("officer"), F.col("event_type").alias("place"),
        F.col("value").cast("decimal(18,2)").alias("fine"), (F.col("event_id") * 7 + F.col("event_id") % 5).alias("number"), "props",
    )


TAGS_SQL = """tags AS (
  SELECT event_id AS tag, ts, user_id AS officer, event_type AS place, CAST(value AS DECIMAL(18,2)) AS fine, event_id * 7 + event_id % 5 AS number, props FROM events)"""


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text places in all their spellings, derived from customer numbers."""
    n = F.col("c_custkey")
    shapes = [
        F.concat(F.lit(" "), n.cast("string"), F.lit(" Main  Street NB")), F.concat((n % 90).cast("string"), F.lit("-12 king street w")), F.concat(F.lit("NR "), (n % 300).cast("string"), F.lit("B Queen St E")),
        F.lit("Yonge St & Bloor Street West"), F.lit(" nan "), F.lit("N/S AT the Elm Grove Ct. "), F.lit("  "), F.concat(F.lit("o'connor DR / Park-On avenue"), (n % 3).cast("string")),
    ]
    pick = F.lit(None).cast("string")
    for k, shape in enumerate(shapes):
        pick = F.when(n % 8 == k, shape).otherwise(pick)
    return table(spark, sf_dir, "customer").select(n.alias("id"), pick.alias("address"))


ADDRESSES_SQL = """addresses AS (
  SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN concat(' ', c_custkey, ' Main  Street NB') WHEN 1 THEN concat(c_custkey % 90, '-12 king street w')
    WHEN 2 THEN concat('NR ', c_custkey % 300, 'B Queen St E') WHEN 3 THEN 'Yonge St & Bloor Street West' WHEN 4 THEN ' nan ' WHEN 5 THEN 'N/S AT the Elm Grove Ct. '
    WHEN 6 THEN '  ' ELSE concat('o''connor DR / Park-On avenue', c_custkey % 3) END AS address FROM customer)"""


def streets(spark: SparkSession) -> DataFrame:
    """A small street network for the addresses: segment_id, street_key, parity, low, high, lon, lat."""
    rows = [
        (1, "MAIN ST", 0, 0, 5000, -79.40, 43.70), (2, "MAIN ST", 1, 1, 5001, -79.40, 43.70), (3, "QUEEN ST E", 0, 0, 98, -79.36, 43.65), (4, "QUEEN ST E", 1, 1, 99, -79.36, 43.65),
        (5, "YONGE ST", 0, 2, 400, -79.38, 43.66), (6, "BLOOR ST W", 0, 2, 400, -79.39, 43.67), (7, "KING ST W", 0, 0, 98, -79.39, 43.64),
    ]
    return spark.createDataFrame(rows, "segment_id int, street_key string, parity int, low int, high int, lon double, lat double")
