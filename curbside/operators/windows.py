"""Window operators over groups, and over one global order without gathering it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int = 1, rank: str = "rn") -> DataFrame:
    """The first ``k`` rows of each group, numbered."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def latest_with_totals(df: DataFrame, key: str, order: Sequence[Column], amount: str) -> DataFrame:
    """The latest row of each key, with the count and sum of all its rows.

    Both are combined before anything is shuffled: sums as partial aggregates, the latest row by the limit of a row number,
    which Spark applies in the map tasks. So a key with very many rows moves as one row from each task. Rows without a key are one group.
    """
    totals = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("row_count"), F.sum(amount).alias("amount_sum"))
    latest = top_per_group(df, [key], order).drop("rn")
    return latest.join(totals, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def numbered_first(df: DataFrame, order: Sequence[Column | str], limit: int) -> DataFrame:
    """The first ``limit`` rows in order with their number and the count of all rows.

    The rows are cut by a distributed top-k before they are numbered, so that only ``limit`` of them meet in one task.
    """
    first = df.orderBy(*order).limit(limit)
    numbered = first.withColumn("rn", F.row_number().over(Window.orderBy(*order)))
    return numbered.crossJoin(F.broadcast(df.agg(F.count("*").alias("available"))))


def ranged(df: DataFrame, order: str, bucket_rows: int) -> DataFrame:
    """Adds ``bucket``: the rows of a dense integer order in ranges of ``bucket_rows``."""
    return df.withColumn("bucket", F.floor(F.col(order) / bucket_rows))


def with_previous(df: DataFrame, order: str, columns: Sequence[str], depth: int = 1, bucket_rows: int = 100_000) -> DataFrame:
    """Each row with the ``columns`` of the ``depth`` rows before it in a global order: prev1_x, prev2_x, ...

    Rows are dealt to ranges of the (integer) order. The last ``depth`` rows of every range also go to the ranges after
    it, far enough to fill them, so no range needs more than its own rows and a few of its predecessors.
    """
    rows = ranged(df, order, bucket_rows)
    tail = top_per_group(rows.select("bucket", order, *columns), ["bucket"], [F.desc(order)], depth).drop("rn")
    tails = tail.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct(order, *columns)), asc=False).alias("tail"))
    # One row for each range, so this window over ranges stays small. A sparse range is filled up from those before it.
    before = F.sort_array(F.collect_list(F.struct("bucket", "tail")).over(Window.orderBy("bucket").rowsBetween(-depth, -1)), asc=False)
    seeds = tails.withColumn("before", before).select("bucket", F.explode(F.slice(F.flatten(F.col("before.tail")), 1, depth)).alias("c"))
    seeds = seeds.select("bucket", "c.*", F.lit(True).alias("seed"))
    w = Window.partitionBy("bucket").orderBy(order)
    out = rows.withColumn("seed", F.lit(False)).unionByName(seeds, allowMissingColumns=True)
    out = out.withColumns({f"prev{k}_{c}": F.lag(c, k).over(w) for c in columns for k in range(1, depth + 1)})
    return out.filter("NOT seed").drop("seed", "bucket")


def rolling_mean(df: DataFrame, order: str, column: str, width: int, bucket_rows: int = 100_000) -> DataFrame:
    """Mean of a row and the ``width`` - 1 rows before it in a global order; at the start of those that are there."""
    wide = with_previous(df, order, [column], width - 1, bucket_rows)
    values = F.filter(F.array(column, *[f"prev{k}_{column}" for k in range(1, width)]), lambda x: x.isNotNull())
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"), lambda a: a / F.size(values))
    return wide.withColumn("rolling_mean", mean).drop(*[f"prev{k}_{column}" for k in range(1, width)])


def share_of_total(df: DataFrame, count: str, keys: Sequence[str] = ()) -> Column:
    """Percent of the group's total."""
    return 100.0 * F.col(count) / F.sum(count).over(Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(1)))


def z_scores(df: DataFrame, value: str) -> DataFrame:
    """Adds ``z``: distance from the mean of all rows in (sample) standard deviations. Mean and deviation are one row."""
    stats = df.agg(F.avg(value).alias("_mean"), F.stddev(value).alias("_sd"))
    return df.crossJoin(F.broadcast(stats)).withColumn("z", F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd"))).drop("_mean", "_sd")
