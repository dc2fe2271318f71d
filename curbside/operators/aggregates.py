"""Grouped aggregates: totals, histograms, profiles, summaries, allocation and masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curbside.functions.values import year_mask


def totals(df: DataFrame, keys: Sequence[str | Column], amount: str = "fine") -> DataFrame:
    """ticket_count and total_revenue by ``keys``; no amount counts as 0."""
    return df.groupBy(*keys).agg(F.count("*").alias("ticket_count"), F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(28,2)").alias("total_revenue"))


def rolled_up(marts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals of totals; rows without a key are left out."""
    kept = marts
    for key in keys:
        kept = kept.filter(F.col(key).isNotNull())
    return kept.groupBy(*keys).agg(F.sum("ticket_count").alias("ticket_count"), F.sum("total_revenue").cast("decimal(28,2)").alias("total_revenue"))


def band(c: Column, limits: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the first limit that ``c`` does not exceed; the last label beyond all."""
    out = F.lit(labels[-1])
    for limit, label in reversed(list(zip(limits, labels, strict=False))):
        out = F.when(c <= limit, F.lit(label)).otherwise(out)
    return out


def histogram_map(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """histogram: map from value to number of rows. Counted before it is collected, so a group holds distinct values only."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("histogram"))


def merged_histograms(df: DataFrame, keys: Sequence[str], histogram: str) -> DataFrame:
    """Histograms of several rows added by value."""
    entries = df.select(*keys, F.explode(histogram).alias("value", "n"))
    sums = entries.groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    return sums.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("histogram"))


def top_value(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group, the smallest of equals, with its count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("value_count"))
    order = Window.partitionBy(*keys).orderBy(F.desc("value_count"), value)
    return counts.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn").withColumnRenamed(value, f"top_{value}")


def completeness(df: DataFrame, column: str) -> DataFrame:
    """How many values are null, blank and filled."""
    c = F.col(column)
    return df.agg(F.count_if(c.isNull()).alias("n_null"), F.count_if(F.trim(c) == "").alias("n_blank"), F.count_if(F.trim(c) != "").alias("n_filled"), F.count("*").alias("n_total"))


def fine_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, mean, least and greatest fine, and days with tickets."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.sum("fine").cast("double") / F.count("fine"), 4).alias("mean_fine"), F.min("fine").alias("min_fine"), F.max("fine").alias("max_fine"), F.count_distinct("ticket_date").alias("days")
    )


def allocated(counts: DataFrame, group: Sequence[str], count: str, total: str, in_doubles: bool = False) -> DataFrame:
    """``revenue``: the group's ``total`` shared out by ``count``, rounded half up to the cent.

    Shares are exact decimals. ``in_doubles``: as in engines whose decimals divide to doubles, where a half cent can fall short and be dropped.
    """
    whole = F.sum(count).over(Window.partitionBy(*group))
    amount = F.col(total).cast("decimal(18,2)") * F.col(count).cast("decimal(12,0)")
    # Spark rounds a double by its shortest spelling (1.005 to 1.01); of 100 times it only true halves go up.
    share = F.round(amount.cast("double") / whole.cast("double") * 100) / 100 if in_doubles else F.round(amount / whole.cast("decimal(14,0)"), 2)
    return counts.withColumn("revenue", F.when(whole > 0, share).otherwise(F.lit(0)).cast("decimal(18,2)"))


def year_totals(df: DataFrame, key: str, months: str) -> DataFrame:
    """Map from 'YYYY-MM' to count, added by year."""
    long = df.select(key, F.explode(months).alias("month", "n"))
    return long.groupBy(key, F.substring("month", 1, 4).cast("int").alias("year")).agg(F.sum("n").alias("n"))


def masks(df: DataFrame, keys: Sequence[str], base: int) -> DataFrame:
    """Count, and which years and months occur as bits."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.bit_or(year_mask(F.col("year"), base)).alias("years_mask"), F.bit_or(year_mask(F.col("month"), 1)).alias("months_mask"))


def ward_totals(df: DataFrame) -> DataFrame:
    """Sums by ward, the number of its sites and its name; rows without ward are left out."""
    return df.filter(F.col("ward_code").isNotNull()).groupBy("ward_code").agg(
        F.min("ward").alias("ward_name"), F.sum("ticket_count").alias("ticket_count"), F.count_distinct("site_key").alias("location_count"), F.sum("total_revenue").cast("decimal(28,2)").alias("total_revenue")
    )


def ward_document(wards: DataFrame, top: int = 10) -> DataFrame:
    """One row: totals, the ``top`` wards by tickets, and all wards by code. Wards are few by nature."""
    row = F.struct("ward_code", "ward_name", "ticket_count", "location_count", "total_revenue")
    by_count = F.array_sort(F.collect_list(F.struct((-F.col("ticket_count")).alias("o"), F.col("ward_code").alias("c"), row.alias("r"))))
    return wards.agg(
        F.struct(F.sum("ticket_count").alias("ticket_count"), F.sum("location_count").alias("location_count"), F.sum("total_revenue").alias("total_revenue")).alias("totals"),
        F.transform(F.slice(by_count, 1, top), lambda x: x["r"]).alias("top_wards"),
        F.array_sort(F.collect_list(row)).alias("wards"),
    )


def grid_clusters(df: DataFrame, sizes: Sequence[float]) -> DataFrame:
    """Points in Mercator metres gathered to square cells of each size: count, amount, mean place."""
    cells = df.select("*", F.explode(F.array(*[F.lit(float(s)) for s in sizes])).alias("grid_metres"))
    cells = cells.withColumns({"cell_x": F.floor(F.col("mx") / F.col("grid_metres")), "cell_y": F.floor(F.col("my") / F.col("grid_metres"))})
    return cells.groupBy("grid_metres", "cell_x", "cell_y").agg(F.count("*").alias("cluster_size"), F.sum("amount").cast("decimal(28,2)").alias("amount"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and their difference."""
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys")).select("n_rows", "n_keys", (F.col("n_rows") - F.col("n_keys")).alias("n_duplicates"))


def pivoted(df: DataFrame, row: str, column: str, most: int = 15) -> DataFrame:
    """Counts of the ``most`` frequent values of ``row`` by those of ``column``: ``row`` and one column for each, 0 where none.

    The names of the columns come from a first aggregate, of which only the first ``most`` rows reach the driver; equal counts go by name.
    Nulls are no value.
    """

    def frequent(name: str) -> DataFrame:
        return df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), name).limit(most)

    names = [r[0] for r in frequent(column).collect()]
    kept = df.join(F.broadcast(frequent(row).select(row)), row).filter(F.col(column).isin(names))
    rows = frequent(row).select(row).join(kept.groupBy(row).pivot(column, names).agg(F.count(F.lit(1))), row, "left")
    return rows.na.fill(0)


def long_form(wide: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """A pivoted table as rows again, of any set of columns."""
    names = [c for c in wide.columns if c != row]
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.col(f"`{c}`") for c in names]))
    return wide.select(row, F.explode(pairs).alias(column, value))
