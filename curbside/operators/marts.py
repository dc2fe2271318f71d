"""Yearly marts of tickets, cameras and wards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.operators.aggregates import allocated, rolled_up, top_value, totals, ward_totals


def location_years(tickets: DataFrame, location: str, code: str) -> DataFrame:
    """By year and location: tickets, revenue and the most frequent code.

    One shuffle: tickets are counted by (year, location, code) first, and both the totals and the top code come from
    these counts.
    """
    counts = tickets.groupBy("year", location, code).agg(F.count("*").alias("n"), F.coalesce(F.sum("fine"), F.lit(0)).alias("s"))
    best = F.min_by(code, F.struct((-F.col("n")).alias("o"), F.col(code))).alias(f"top_{code}")
    out = counts.groupBy("year", location).agg(F.sum("n").alias("ticket_count"), F.sum("s").cast("decimal(28,2)").alias("total_revenue"), best)
    return out.withColumn("location_key", F.md5(F.col(location)))


def parking_marts(tickets: DataFrame, street: str, neighbourhood: str) -> dict[str, DataFrame]:
    """The location, street and neighbourhood marts; the latter two from the counts of the first."""
    base = totals(tickets, ["year", "location", street, neighbourhood])
    return {
        "locations": location_years(tickets, "location", "brand"),
        "streets": rolled_up(base, ["year", street]),
        "neighbourhoods": rolled_up(base, ["year", neighbourhood]),
    }


def camera_years(counts: DataFrame, sites: DataFrame, in_doubles: bool = False) -> DataFrame:
    """Yearly counts of sites with their share of the site's whole revenue, see ``allocated``. ``sites``: site_key, total; others pass."""
    return allocated(counts.join(sites, "site_key"), ["site_key"], "n", "total", in_doubles)


def historical_sites(charges: DataFrame, sites: DataFrame) -> DataFrame:
    """Charged sites that are no longer listed."""
    return charges.join(sites, "site_key", "left_anti")


def camera_summary(sites: DataFrame, charges: DataFrame) -> dict[str, DataFrame]:
    """Totals, breakdowns by ward and division, and the ten busiest sites of one camera programme."""
    joined = sites.join(charges, "site_key")
    figures = [F.count("*").alias("n_sites"), F.sum("ticket_count").alias("ticket_count"), F.sum("total_revenue").cast("decimal(28,2)").alias("total_revenue")]
    return {
        "totals": joined.agg(*figures),
        "wards": joined.groupBy("ward").agg(*figures),
        "divisions": joined.groupBy("division").agg(*figures),
        "top": joined.orderBy(F.desc("ticket_count"), "site_key").limit(10),
    }


def combined_wards(first: DataFrame, second: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Ward totals of two programmes side by side and together."""
    both = first.withColumn("programme", F.lit(names[0])).unionByName(second.withColumn("programme", F.lit(names[1])))
    each = [F.coalesce(F.sum(F.when(F.col("programme") == n, F.col("ticket_count"))), F.lit(0)).alias(f"{n}_tickets") for n in names]
    return both.groupBy("ward_code").agg(*each, F.sum("ticket_count").alias("ticket_count"))


__all__ = ["camera_summary", "camera_years", "combined_wards", "historical_sites", "location_years", "parking_marts", "top_value", "ward_totals"]
