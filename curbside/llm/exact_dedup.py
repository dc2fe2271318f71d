"""Exact deduplication by skew-safe combining.

Three stages, each of which compares whole contents and not digests alone:

1. within a map task, equal texts are combined before anything is shuffled (Spark's partial aggregation, whose keys
   hold the text);
2. what is left is merged by (digest, salt, text), so one group of copies is spread over ``salts`` tasks;
3. the winners of the salts are merged by (digest, text).

After stage 1 a group of copies has one row for each map task and salt at most, however large it is. The groups are cut
there. Members then find their group by SHA-256, XXH64 and length: that these name one text only is verified over all
groups, which hold every different text, so contents need not move again. Groups of several rows are repeated for each
salt, so the members of a large group are spread, too.

Texts are lower-cased (A-Z only) and hashed in Arrow batches: Spark's ``translate`` takes about eight times the CPU time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.llm.common import cut, named_rows

SALTS = 8
_KEY = ["digest", "second", "size"]


def _normalised(more: str = ""):
    """Batches (doc_id, text) as doc_id and the key of the normalised text, with its ``content`` or with a digest of the text
    itself (``own``), if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            lower = [b.lower() for b in raw]  # bytes.lower: A-Z only
            columns = [
                batch.column(0),
                pa.array([hashlib.sha256(b).digest() for b in lower], pa.binary()),
                pa.array([xxhash.xxh64_intdigest(b) - (1 << 63) for b in lower], pa.int64()),
                pa.array(list(map(len, lower)), pa.int64()),
            ]
            names = ["doc_id", *_KEY]
            if more:
                columns.append(pa.array(lower if more == "content" else [hashlib.sha256(b).digest() for b in raw], pa.binary()))
                names.append(more)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


_ROW = "doc_id long, digest binary, second long, size long"


def groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per different text of ``docs``: digest, second, size (its key), keep_id, group_size."""
    tagged = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_normalised("content"), f"{_ROW}, content binary")
    salted = tagged.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    by_salt = salted.groupBy(*_KEY, "salt", "content").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    merged = by_salt.groupBy(*_KEY, "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    narrow = cut(merged.select(*_KEY, "keep_id", "group_size"))
    if narrow.groupBy(*_KEY).count().filter("count > 1").limit(1).count():
        raise ArithmeticError("two different texts share SHA-256, XXH64 and length")
    return narrow


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and texts are compared whole. ``keep_id``
    is the largest doc_id of the group. Repeated rows (same doc_id and text) all count in ``group_size`` and are all kept
    if theirs is the largest id. A null doc_id counts in group_size, never becomes keep_id unless all ids of the group
    are null, and is kept only then. An empty table gives no rows. Other columns are ignored.
    """
    several = groups(docs, salts).filter("group_size > 1").select(*_KEY, "keep_id", "group_size")
    spread = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    members = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_normalised(), _ROW)
    members = members.withColumn("salt", (F.monotonically_increasing_id() % salts).cast("int"))
    found = members.join(spread, [*_KEY, "salt"], "left")  # who finds none is alone
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that stay, with all their columns: one row of each group of equal texts.

    It is the row with the largest doc_id, of several under that id the one whose text has the greatest SHA-256, and any
    one of rows that repeat both. Equal texts, nulls, long texts and empty tables as in :func:`exact_dedup`; rows
    that share a doc_id are judged each by its own text.
    """
    keepers = groups(docs, salts).select(*_KEY, F.col("keep_id").alias("doc_id"))
    rows = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_normalised("own"), f"{_ROW}, own binary").distinct()
    found = rows.alias("r").join(keepers.alias("k"), [F.col(f"r.{c}") == F.col(f"k.{c}") for c in _KEY] + [F.col("r.doc_id").eqNullSafe(F.col("k.doc_id"))])
    chosen = found.groupBy(*[F.col(f"r.{c}") for c in [*_KEY, "doc_id"]]).agg(F.max("own").alias("own"))
    return named_rows(docs, chosen.select("doc_id", "own"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
      FROM documents)
WINDOW same AS (PARTITION BY norm)
"""
