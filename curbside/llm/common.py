"""What several operators share: durable cuts of the lineage, batch sizes, connected components."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where none is set a temporary one is made, but only for a local master (tests, a laptop): executors of a cluster
    could not see it, so there an unset folder is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names`` with underscores added until none clashes with ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_long_id(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """``df`` with its text column ``name`` as a number again.

    Pandas holds whole numbers beside nulls as doubles, which changes those beyond 2**53; so ids go through it as texts.
    """
    return df.withColumn(name, F.col(name).cast("long"))


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder.

    The files outlive any executor, so a lost executor costs no recomputation of what was cut.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, so that later readers take the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def labelled_texts(docs: DataFrame, marks: DataFrame, per_label: int) -> DataFrame:
    """Rows (doc_id, y, text) for a bounded sample of ``marks`` (doc_id, y): of each y the ``per_label`` first by a hash.

    Rows of ``docs`` that repeat a doc_id count once, with the least of their texts, so the sample stays bounded.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = marks.filter("y = 1").orderBy(*order).limit(per_label).unionAll(marks.filter("y = 0").orderBy(*order).limit(per_label))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def named_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that ``chosen`` (doc_id, own: SHA-256 of the text) names, one for each name.

    A row is known by its doc_id and its text, so rows that share an id, or have none, are told apart. Of rows with the
    same id and text any one stays. Texts move once; ids are part of the key, so the rows of one text are spread.
    """
    key = ["_id", "_none", "_own"]
    names = chosen.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("own").alias("_own"))
    packed = docs.select(
        F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("_row"),
        F.coalesce(F.col("doc_id"), F.lit(0)).alias("_id"),
        F.col("doc_id").isNull().alias("_none"),
        F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)).alias("_own"),
    )
    rows = packed.join(names, key, "left_semi").dropDuplicates(key)
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (src long, dst long): rows (node, component), component the least node.

    Alternates large-star and small-star steps: every step is two joins of the edge list with one minimum per node,
    so no neighbour list is ever gathered, and a hub's edges can be split by adaptive skew joins.
    Each round is checkpointed; it ends when a round changes nothing. Nodes without edges are absent.
    """
    current = cut(
        edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    signature = None
    for _ in range(max_rounds):
        both = current.select("u", "v").unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        current = cut(least.select("u", F.col("m").alias("v")).unionAll(small).distinct())
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == signature:
            break
        signature = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
