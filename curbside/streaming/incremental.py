"""Loads that skip what did not change."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def changed(manifest: DataFrame, state: DataFrame) -> DataFrame:
    """Resources (slug, last_modified, sha1) that are new or differ from the state of the last load."""
    old = state.select("slug", F.col("last_modified").alias("_m"), F.col("sha1").alias("_s"))
    out = manifest.join(old, "slug", "left")
    same = F.col("last_modified").eqNullSafe(F.col("_m")) & F.col("sha1").eqNullSafe(F.col("_s"))
    return out.filter(F.col("_s").isNull() | ~same).drop("_m", "_s")


def state_digest(manifest: DataFrame) -> DataFrame:
    """One digest over the digests of all resources, in order of slug."""
    pairs = F.array_sort(F.collect_list(F.concat_ws(":", "slug", "sha1")))
    return manifest.agg(F.sha1(F.concat_ws("|", pairs)).alias("digest"))


def needs_rebuild(manifest: DataFrame, state: DataFrame, schema_version: int) -> DataFrame:
    """Data sets whose checksum or schema version changed, or that were never built."""
    old = state.select("slug", F.col("sha1").alias("_s"), F.col("schema_version").alias("_v"))
    out = manifest.join(old, "slug", "left")
    return out.filter(F.col("_s").isNull() | (F.col("_s") != F.col("sha1")) | (F.col("_v") != schema_version)).select("slug")


def chunked(items: Iterable, size: int) -> Iterator[list]:
    """Lists of at most ``size`` items: years of one load, for instance."""
    part: list = []
    for item in items:
        part.append(item)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def load_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files_at_once: int = 8) -> StreamingQuery:
    """Appends Parquet files that were not loaded before, a few at a time; the checkpoint remembers them."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
