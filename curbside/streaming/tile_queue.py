"""A work queue of tiles: rendered, sent back for another try, or given up.

Requests (dataset, shard, z, x, y, attempt, not_before) arrive as files; a checkpoint makes delivery at least once. All
that a batch writes, retries included, goes to folders named by its number, so a batch that is repeated replaces its own
files. A request whose time has not come is put back as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

REQUEST_SCHEMA = "dataset string, shard string, z int, x long, y long, attempt int, not_before long"
MOST_ATTEMPTS = 5


def backoff_seconds(attempt: Column, base: float = 2.0, most: float = 300.0) -> Column:
    """Waits double from one attempt to the next, up to ``most``."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))


def outcomes(requests: DataFrame, rendered: DataFrame) -> DataFrame:
    """Requests with an ``outcome``: done if ``rendered`` (dataset, z, x, y, ok) says so, else retry, or dead after
    MOST_ATTEMPTS. Retries carry the next attempt and the seconds to wait.
    """
    keys = ["dataset", "z", "x", "y"]
    out = requests.join(rendered.select(*keys, "ok"), keys, "left")
    state = F.when(F.coalesce("ok", F.lit(False)), "done").when(F.col("attempt") >= MOST_ATTEMPTS, "dead").otherwise("retry")
    wait = F.when(state == "retry", backoff_seconds(F.col("attempt"))).otherwise(0.0)
    return out.withColumns({"outcome": state, "wait_seconds": wait, "next_attempt": F.when(state == "retry", F.col("attempt") + 1)}).drop("ok")


def run_queue(spark: SparkSession, source: str, render: Callable[[DataFrame], DataFrame], done: str, dead: str, checkpoint: str, now: Column | None = None) -> StreamingQuery:
    """Works off all requests in ``source`` that are due by ``now`` (seconds, the clock by default). Retries and requests
    that are not due are put back into it as new files, for the next run."""
    seconds = F.unix_timestamp() if now is None else now

    def batch(requests: DataFrame, number: int) -> None:
        taken = requests.withColumn("now", seconds.cast("long")).dropDuplicates(["dataset", "z", "x", "y", "attempt"]).persist()
        distinct = taken.filter("coalesce(not_before, 0) <= now")
        early = taken.filter("coalesce(not_before, 0) > now").drop("now")
        split = outcomes(distinct, render(distinct)).persist()
        keys = ["dataset", "shard", "z", "x", "y"]
        split.filter("outcome = 'done'").select(*keys, "attempt").write.mode("overwrite").parquet(f"{done}/batch={number}")
        split.filter("outcome = 'dead'").select(*keys, "attempt").write.mode("overwrite").parquet(f"{dead}/batch={number}")
        again = split.filter("outcome = 'retry'").select(*keys, F.col("next_attempt").alias("attempt"), (F.col("now") + F.col("wait_seconds")).cast("long").alias("not_before"))
        back = again.unionByName(early.select(*again.columns))
        if not back.isEmpty():
            back.write.mode("overwrite").parquet(f"{source}/again-{number}")
        split.unpersist()
        taken.unpersist()

    stream = spark.readStream.schema(REQUEST_SCHEMA).option("recursiveFileLookup", "true").parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(done: DataFrame, total: int, rebuild_every: int = 1000) -> DataFrame:
    """Keyed counters of finished tiles; ``rebuild`` is set when ``rebuild_every`` more are done or all are.

    ``done`` may be a stream. The state of a shard is two numbers.
    """

    def count(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        finished, pending = state.get if state.exists else (0, 0)
        for frame in frames:
            finished, pending = finished + len(frame), pending + len(frame)
        rebuild = pending >= rebuild_every or finished >= total
        state.update((finished, 0 if rebuild else pending))
        yield pd.DataFrame({"dataset": [key[0]], "shard": [key[1]], "finished": [finished], "rebuild": [rebuild]})

    return done.groupBy("dataset", "shard").applyInPandasWithState(
        count, "dataset string, shard string, finished long, rebuild boolean", "finished long, pending long", "update", GroupStateTimeout.NoTimeout
    )
