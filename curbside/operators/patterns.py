"""Sequences of ticket numbers and times: differences, digits, transitions, bursts, batches and predictions.

Every function takes tags (tag, number, ts, officer, place, fine). The global order of tags is never gathered in one
task; see ``windows.with_previous``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curbside.operators.windows import share_of_total, top_per_group, with_previous


def differences(tags: DataFrame, depth: int = 3) -> DataFrame:
    """Adds diff1..diffN: the number minus those 1..N tags before."""
    wide = with_previous(tags, "tag", ["number"], depth)
    return wide.withColumns({f"diff{k}": F.col("number") - F.col(f"prev{k}_number") for k in range(1, depth + 1)}).drop(*[f"prev{k}_number" for k in range(1, depth + 1)])


def common_differences(tags: DataFrame, top: int = 20) -> DataFrame:
    counts = differences(tags, 1).filter("diff1 IS NOT NULL").groupBy("diff1").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "diff1").limit(top)


def digit_pairs(tags: DataFrame) -> DataFrame:
    """Last digits of each number and the one before it."""
    wide = with_previous(tags, "tag", ["number"])
    return wide.filter("prev1_number IS NOT NULL").select("tag", (F.col("prev1_number") % 10).alias("previous"), (F.col("number") % 10).alias("digit"), (F.col("number") - F.col("prev1_number")).alias("diff"))


def rule_by_digit(tags: DataFrame) -> DataFrame:
    """The usual difference after each last digit, and the share of cases it holds in."""
    counts = digit_pairs(tags).groupBy("previous", "diff").agg(F.count("*").alias("n"))
    shared = counts.withColumn("percent", share_of_total(counts, "n", ["previous"]))
    return top_per_group(shared, ["previous"], [F.desc("n"), "diff"]).drop("rn")


def digit_frequency(tags: DataFrame) -> DataFrame:
    """How often each last digit occurs, digits that never do included."""
    counts = tags.groupBy((F.col("number") % 10).alias("digit")).agg(F.count("*").alias("n"))
    digits = tags.sparkSession.range(10).select(F.col("id").alias("digit"))
    all_of = digits.join(counts, "digit", "left").select("digit", F.coalesce("n", F.lit(0)).alias("n"))
    return all_of.withColumn("percent", share_of_total(all_of, "n"))


def transitions(tags: DataFrame) -> DataFrame:
    """Percent of each next last digit after each last digit, long form."""
    counts = digit_pairs(tags).groupBy("previous", "digit").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", share_of_total(counts, "n", ["previous"]))


def transition_matrix(tags: DataFrame) -> DataFrame:
    """One row for each digit, one column for each next digit."""
    matrix = transitions(tags).groupBy("previous").pivot("digit", list(range(10))).agg(F.first("percent"))
    return matrix.select("previous", *[F.coalesce(F.col(str(k)), F.lit(0.0)).alias(f"to_{k}") for k in range(10)])


def dominant_transitions(tags: DataFrame, percent: float = 50.0) -> DataFrame:
    return transitions(tags).filter(F.col("percent") >= percent)


def minutes_since_previous(tags: DataFrame) -> DataFrame:
    """Minutes since the tag before, in order of tags; may be negative."""
    wide = with_previous(tags, "tag", ["ts"])
    return wide.withColumn("minutes_since", (F.unix_micros("ts") - F.unix_micros("prev1_ts")) / 60_000_000.0).drop("prev1_ts")


def same_place(tags: DataFrame) -> DataFrame:
    """Whether the tag before was written at the same place."""
    wide = with_previous(tags, "tag", ["place"])
    return wide.withColumn("same_place", F.coalesce(F.col("place") == F.col("prev1_place"), F.lit(False))).drop("prev1_place")


def daily(tags: DataFrame) -> DataFrame:
    """Numbers and fines by day."""
    out = tags.groupBy(F.to_date("ts").alias("day")).agg(
        F.min("number").alias("first_number"), F.max("number").alias("last_number"), F.count("*").alias("n"), F.count_distinct("number").alias("n_numbers"),
        F.mode("place", True).alias("usual_place"), F.sum("fine").cast("decimal(28,2)").alias("fines"), F.round(F.sum("fine").cast("double") / F.count("fine"), 4).alias("mean_fine"),
    )
    return out.withColumn("number_range", F.col("last_number") - F.col("first_number"))


def by_time(tags: DataFrame, key: Column, name: str) -> DataFrame:
    """Count, fines, mean fine and places by a part of the time."""
    return tags.groupBy(key.alias(name)).agg(
        F.count("*").alias("n"), F.sum("fine").cast("decimal(28,2)").alias("fines"), F.round(F.sum("fine").cast("double") / F.count("fine"), 4).alias("mean_fine"), F.count_distinct("place").alias("n_places"), F.mode("place", True).alias("usual_place")
    )


def window_productivity(tags: DataFrame, minutes: int = 10) -> DataFrame:
    """Most, mean and 95th percentile of tags per window of time that has any."""
    counts = tags.groupBy(F.window("ts", f"{minutes} minutes")).agg(F.count("*").alias("n"))
    return counts.agg(F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.percentile("n", 0.95), 6).alias("p95"))


def batch_size(tags: DataFrame, sizes: Sequence[int] = (25, 50, 100, 200), slack: int = 10, least: float = 30.0) -> DataFrame:
    """Percent of differences that lie within ``slack`` of a multiple of each size; ``best`` marks the first largest over ``least``."""
    gaps = differences(tags, 1).filter("diff1 > 0").select(F.col("diff1").alias("gap"))
    tried = gaps.select("gap", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    rest = F.col("gap") % F.col("size")
    shares = tried.groupBy("size").agg(F.round(100.0 * F.avg(((rest <= slack) | (rest >= F.col("size") - slack)).cast("double")), 6).alias("percent"))
    rank = F.row_number().over(Window.orderBy(F.desc("percent"), "size"))
    return shares.withColumn("best", (rank == 1) & (F.col("percent") > least))


def batches(tags: DataFrame, size: int = 100) -> DataFrame:
    """Numbers in books of ``size``: what was used of each, over how many days, where."""
    booked = tags.withColumn("batch", F.floor(F.col("number") / size))
    out = booked.groupBy("batch").agg(
        F.min("number").alias("first_number"), F.max("number").alias("last_number"), F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("n_days"), F.mode("place", True).alias("usual_place"), F.mode("officer", True).alias("usual_officer")
    )
    return out.withColumn("same_day", F.col("n_days") == 1)


def officers_by_period(tags: DataFrame, period: str = "DAY", size: int = 100) -> DataFrame:
    """Books in use by day, week or hour, as an estimate of officers, and tickets to each."""
    booked = tags.withColumn("batch", F.floor(F.col("number") / size))
    out = booked.groupBy(F.date_trunc(period, "ts").alias("period")).agg(F.count_distinct("batch").alias("n_batches"), F.count("*").alias("n"))
    return out.withColumn("per_batch", F.round(F.col("n") / F.col("n_batches"), 6))


def incomplete_batches(tags: DataFrame, size: int = 100) -> DataFrame:
    """Books with numbers left, the range they should cover, and how many are missing."""
    kept = batches(tags, size).filter(F.col("n") < size)
    return kept.select("batch", "n", (F.col("batch") * size).alias("expected_first"), ((F.col("batch") + 1) * size - 1).alias("expected_last"), (size - F.col("n")).alias("missing"), "last_number", "usual_place")


def prediction_accuracy(tags: DataFrame) -> DataFrame:
    """How often the usual difference after a last digit gives the next number; over all pairs, not a sample."""
    pairs, rules = digit_pairs(tags), rule_by_digit(tags).select("previous", F.col("diff").alias("expected"))
    hits = pairs.join(F.broadcast(rules), "previous")  # ten rules at most
    return hits.agg(F.count("*").alias("n"), F.round(F.avg((F.col("diff") == F.col("expected")).cast("double")), 6).alias("accuracy"))


def predicted_next(tags: DataFrame, steps: int = 3) -> DataFrame:
    """The next ``steps`` numbers after the last one of each officer, by the rules of last digits."""
    rules = rule_by_digit(tags).agg(F.map_from_entries(F.collect_list(F.struct("previous", "diff"))).alias("rules"))
    last = tags.groupBy("officer").agg(F.max_by("number", "tag").alias("number")).crossJoin(F.broadcast(rules))
    grow = lambda a, _: F.concat(a, F.array(F.element_at(a, -1) + F.coalesce(F.try_element_at("rules", F.element_at(a, -1) % 10), F.lit(1))))
    chain = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(F.col("number")), grow)
    return last.select("officer", "number", F.slice(chain, 2, steps).alias("predicted"))


def monitoring_list(tags: DataFrame, size: int = 100, top: int = 20) -> DataFrame:
    """Open books by how nearly they are used up: where to look for the next numbers."""
    open_books = incomplete_batches(tags, size)
    return open_books.select("batch", "usual_place", "missing", (F.col("last_number") + 1).alias("next_number"), F.round(100.0 * F.col("n") / size, 2).alias("used_percent")).orderBy(F.desc("used_percent"), "batch").limit(top)


def anomalies(tags: DataFrame, bound: float = 2.0) -> DataFrame:
    """Days whose number of tickets lies more than ``bound`` deviations from the mean."""
    from curbside.operators.windows import z_scores

    days = tags.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return z_scores(days, "n").withColumn("unusual", F.abs("z") > bound)
