"""Answers to repeated requests, kept in a mart with an expiry.

``requests``: key, ...; ``mart``: key, value, expires_at, used_at (both in seconds). However many requests ask for a key,
it is worked out once. Answers past their expiry still serve for a grace period, while they are worked out anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcomes(requests: DataFrame, mart: DataFrame, now: Column, grace_seconds: int) -> DataFrame:
    """Every different key that was asked for, with its value if the mart may serve it, and ``outcome``: fresh, stale or missing."""
    found = requests.select("key").filter("key IS NOT NULL").distinct().join(mart.select("key", "value", "expires_at"), "key", "left")
    outcome = F.when(F.col("expires_at") > now, "fresh").when(F.col("expires_at") + grace_seconds > now, "stale").otherwise("missing")
    return found.select("key", F.when(outcome != "missing", F.col("value")).alias("value"), outcome.alias("outcome"))


def answered(requests: DataFrame, mart: DataFrame, compute: Callable[[DataFrame], DataFrame], now: Column, ttl_seconds: int, grace_seconds: int) -> tuple[DataFrame, DataFrame]:
    """The requests with value and outcome, and the mart as it is afterwards.

    ``compute`` gives (key, value) for a table of different keys: of those missing, to answer the requests, and of those
    stale as well, for the mart. A key that it gives no value for is answered with null and not kept.
    """
    asked = outcomes(requests, mart, now, grace_seconds)
    made = compute(asked.filter("outcome <> 'fresh'").select("key")).select("key", F.col("value").alias("made"))
    both = asked.join(made, "key", "left")
    served = both.select("key", F.when(F.col("outcome") == "missing", F.col("made")).otherwise(F.col("value")).alias("value"), "outcome")
    renewed = made.filter("made IS NOT NULL").select("key", F.col("made").alias("value"), (now + ttl_seconds).cast("long").alias("expires_at"), now.cast("long").alias("used_at"))
    used = asked.select("key", now.cast("long").alias("now_used"))
    old = mart.join(renewed.select("key"), "key", "left_anti").join(used, "key", "left")
    kept = old.filter(F.col("expires_at") + grace_seconds > now).select("key", "value", "expires_at", F.coalesce("now_used", "used_at").alias("used_at"))
    return requests.join(served, "key", "left"), kept.unionByName(renewed)


def within_size(mart: DataFrame, size: Column, most: int) -> DataFrame:
    """The rows of ``mart`` used last whose summed ``size`` is ``most`` at most. Sizes are summed by second of use first, so
    only one number for each second is put in order."""
    sized = mart.withColumn("_size", size.cast("long"))
    seconds = sized.groupBy("used_at").agg(F.sum("_size").alias("_sum"))
    running = seconds.select("used_at", F.sum("_sum").over(Window.orderBy(F.desc("used_at")).rowsBetween(Window.unboundedPreceding, 0)).alias("_until"))
    return sized.join(running.filter(F.col("_until") <= most).select("used_at"), "used_at", "left_semi").drop("_size")
