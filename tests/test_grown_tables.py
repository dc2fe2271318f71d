"""Queries that met their SQL on the small tables only: each on the smallest tables that told them apart."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from curbside.operators import marts
from curbside.plans import catalog


@pytest.fixture
def differing(spark, tmp_path):
    """Rows that a query and its SQL do not share, over tables given by name."""
    duckdb = pytest.importorskip("duckdb")

    def rows(query, **tables):
        connection = duckdb.connect()
        for name, df in tables.items():
            path = f"{tmp_path}/{name}.parquet"
            df.write.parquet(path)
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
        expected = connection.execute(catalog.oracle_sql()[query])
        columns = [c[0] for c in expected.description]
        wanted = sorted(map(repr, expected.fetchall()))
        found = sorted(repr(tuple(r)) for r in catalog.queries()[query](spark, str(tmp_path)).select(*columns).collect())
        return (found, wanted) if found != wanted else None

    return rows


def test_chunk_of_several_parts_is_one_entry(spark, differing):
    segment = F.when(F.col("id") < 25_000, "BUILDING").when(F.col("id") < 25_010, "MACHINERY")
    customer = spark.range(25_015).select(F.col("id").alias("c_custkey"), segment.alias("c_mktsegment"))
    assert differing("SNK16_chunk_manifest", customer=customer) is None


def test_equally_near_pairs_go_by_ids(spark, differing):
    """Both pairs are 137 keys apart and so equally far, but for the last digits of their coordinates."""
    rows = [(1070, "BUILDING"), (933, "MACHINERY"), (1067, "BUILDING"), (1204, "MACHINERY")]
    customer = spark.createDataFrame([(k, f"c{k}", 16, 0.0, segment) for k, segment in rows], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    assert differing("JOI18_nearest_pair", customer=customer) is None


def test_nearest_pairs_are_found_among_all_points(spark, differing):
    """Some fifty points of each side in an area; one side's alone; rows without a key or an area."""
    segment = lambda k: "FURNITURE" if k % 9 == 8 else ("BUILDING", "MACHINERY")[k // 8 % 2]
    rows = [(k, segment(k), k % 8) for k in range(1, 1_000)]
    odd = [(None, "BUILDING", 1), (None, "MACHINERY", 1), (None, "BUILDING", 9), (7, "MACHINERY", 9), (8, "MACHINERY", None), (9, "BUILDING", None), (10, "BUILDING", 10)]
    customer = spark.createDataFrame([(k, f"c{k}", area, 0.0, s) for k, s, area in rows + odd], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    assert differing("JOI18_nearest_pair", customer=customer) is None


def test_half_cents_of_shares_are_those_of_the_sql(spark, differing):
    """In doubles half of 0.29 is just under 14.5 cents and half of 0.25 is 12.5; the tenth is rounded after the cent."""
    lines = [(k, 1, k, 1, 10.0, "A", "F", f"{year}-05-01") for k in range(4) for year in (1995, 1996)]
    differ = differing(
        "AGG51_allocated",
        lineitem=spark.createDataFrame(lines, "l_suppkey long, l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_linestatus string, day string").withColumn("l_shipdate", F.to_timestamp("day")),
        supplier=spark.createDataFrame([(0, "a", 0, 0.29), (1, "b", 0, 0.25), (2, "c", 0, 4.89), (3, "d", 0, -5.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        nation=spark.createDataFrame([(0, "n", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        region=spark.createDataFrame([(0, "r")], "r_regionkey int, r_name string"),
    )
    assert differ is None


def test_shares_are_exact_unless_asked_for_in_doubles(spark):
    counts = spark.createDataFrame([(1, 1995, 1), (1, 1996, 1)], "site_key int, year int, n long")
    sites = spark.createDataFrame([(1, Decimal("0.29"))], "site_key int, total decimal(18,2)")
    assert {r.revenue for r in marts.camera_years(counts, sites).collect()} == {Decimal("0.15")}
    assert {r.revenue for r in marts.camera_years(counts, sites, in_doubles=True).collect()} == {Decimal("0.14")}
