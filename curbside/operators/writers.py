"""Writers: append, full refresh, partition replacement, upserts, updates, documents and manifests.

Parquet tables have no MERGE; an upsert is a full outer merge whose result replaces the touched partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.operators.windows import top_per_group


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def refresh(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Only the partitions that ``df`` has rows of are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return top_per_group(df, keys, order).drop("rn")


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_old_if_null: Sequence[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` (one for each key) put in; columns in ``keep_old_if_null`` are not overwritten by null."""
    others = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*others).alias("o"))
    n = new.select(*keys, F.struct(*others).alias("n"))
    both = o.join(n, list(keys), "full")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep_old_if_null else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*keys, *[pick(c).alias(c) for c in others]).select(*old.columns)


def updated(target: DataFrame, source: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``target`` with ``columns`` from ``source`` where it has the key and a value."""
    s = source.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = target.join(s, key, "left")
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(*target.columns)


def backfilled(facts: DataFrame, lookup: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Fills nulls of ``columns`` from ``lookup`` in one pass over the set."""
    s = lookup.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return facts.join(s, key, "left").withColumns({c: F.coalesce(c, f"_new_{c}") for c in columns}).select(*facts.columns)


def swap_in(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Writes beside ``path`` and renames, so readers see the old table or the new one."""
    fresh, gone = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(fresh)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh, gone))
    fs = target.getFileSystem(conf)
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(new, target)
    fs.delete(old, True)


def write_features(df: DataFrame, order: str, path: str) -> None:
    """A GeoJSON collection of features (lon, lat and properties) in order, as text parts with a feature in each line.

    The parts, put together by their names, are one document; no task holds more than it sorts. ``order`` has no null and no value twice.
    """
    properties = F.struct(*[c for c in df.columns if c not in ("lon", "lat")])
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), properties.alias("properties")))
    first = df.agg(F.min(order)).first()[0]
    lines = df.select(F.lit(1).alias("_section"), F.col(order).alias("_order"), F.concat(F.when(F.col(order) == first, "").otherwise(","), feature).alias("value"))
    ends = [(0, '{"type":"FeatureCollection","features":['), (2, "]}")]
    frame = df.sparkSession.createDataFrame(ends, "_section int, value string").select("_section", F.lit(None).cast(df.schema[order].dataType).alias("_order"), "value")
    lines.unionByName(frame).repartitionByRange("_section", "_order").sortWithinPartitions("_section", "_order").select("value").write.text(path)


def payload_manifest(df: DataFrame, chunk: str, part_rows: int = 10_000) -> DataFrame:
    """Key, part, row count, slug, digest and gzip+base64 payload of each chunk's rows.

    A chunk has as many parts as it needs for about ``part_rows`` rows each, so no payload grows with the table.
    """
    from curbside.functions.slow import packed
    from curbside.functions.text import slug

    own = [c for c in df.columns if c != chunk]
    parts = df.groupBy(F.col(chunk).alias("_chunk")).agg(F.ceil(F.count("*") / part_rows).alias("_parts"))
    dealt = df.join(parts, F.col(chunk).eqNullSafe(F.col("_chunk"))).withColumn("part", F.pmod(F.xxhash64(*own), F.col("_parts")))
    rows = F.to_json(F.array_sort(F.collect_list(F.struct(*own))))
    out = dealt.groupBy(chunk, "part").agg(F.count("*").alias("n"), rows.alias("raw"))
    return out.select(chunk, "part", "n", slug(F.col(chunk)).alias("slug"), F.sha2("raw", 256).alias("etag"), packed(F.col("raw")).alias("payload"))


def chunk_manifest(payloads: DataFrame, chunk: str) -> DataFrame:
    """One entry for each chunk of ``payload_manifest``: its slug, and the rows and number of all its parts."""
    return payloads.groupBy(chunk, "slug").agg(F.sum("n").alias("n"), F.count("*").alias("parts"))
