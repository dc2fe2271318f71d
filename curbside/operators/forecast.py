"""Seasonal forecast by place: means weighted by recency, confidence and trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def predictions(yearly: DataFrame, key: str) -> DataFrame:
    """Per place: expected tickets and revenue, confidence and trend. ``yearly``: key, year, n, revenue.

    A year's weight is 0.6 + 0.4 x its place between the first and last year of all data. Confidence is
    0.4 x recency-free coverage + 0.4 + 0.2 x (1 - variation), as far as the years go. The trend compares the mean of
    the last three years with that of the years before and needs three years.
    """
    span = yearly.agg(F.min("year").alias("y0"), F.max("year").alias("y1"), F.count_distinct("year").alias("all_years"))
    rows = yearly.crossJoin(F.broadcast(span))
    recency = F.when(F.col("y1") > F.col("y0"), (F.col("year") - F.col("y0")) / (F.col("y1") - F.col("y0"))).otherwise(F.lit(1.0))
    rows = rows.withColumn("w", 0.6 + 0.4 * recency)
    out = rows.groupBy(key).agg(
        (F.sum(F.col("w") * F.col("n")) / F.sum("w")).alias("tickets"), (F.sum(F.col("w") * F.col("revenue").cast("double")) / F.sum("w")).alias("revenue"),
        F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.count("*").alias("years"), F.first("all_years").alias("all_years"), F.array_sort(F.collect_list(F.struct("year", "n"))).alias("series"),
    )
    variation = F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(F.lit(1.0))
    coverage = F.least(F.lit(1.0), F.col("years") / F.greatest(F.lit(1), F.col("all_years")))
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.4 + 0.4 * coverage + 0.2 * (1 - F.least(F.lit(1.0), variation))))
    counts = F.transform("series", lambda x: x["n"].cast("double"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.lit(1), F.size(a))
    recent = F.slice(counts, -3, 3)
    prior = F.when(F.size(counts) > 3, F.slice(counts, F.lit(1), F.greatest(F.lit(1), F.size(counts) - 3))).otherwise(F.slice(counts, 1, 1))
    change = F.when((F.size(counts) >= 3) & (mean(prior) > 0), 100.0 * (mean(recent) - mean(prior)) / mean(prior)).otherwise(F.lit(0.0))
    trend = F.when(change > 10, "rising").when(change < -10, "falling").otherwise("steady")
    return out.select(key, F.round("tickets", 4).alias("tickets"), F.round("revenue", 4).alias("revenue"), F.round(confidence, 6).alias("confidence"), F.round(change, 4).alias("change_percent"), trend.alias("trend"), "years")


def as_geojson(rows: DataFrame, key: str) -> DataFrame:
    """One GeoJSON feature for each row, as text. Needs lon and lat."""
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(*[c for c in rows.columns if c not in ("lon", "lat")]).alias("properties")
    )
    return rows.select(key, F.to_json(feature).alias("feature"))
