"""From raw documents to token ids in five stages, each one operator of ``curbside.llm``.

Every stage works on all rows that the one before kept, and its result is written as Parquet in the shared folder of the
cluster, so a lost executor costs a stage's tasks and not the pipeline. All stages but the last return the columns of
``documents``.

Rows are known by doc_id and text together, so rows that share an id, or have none, are judged each by its own text.
Null texts count as empty, texts are read whole, repeated rows become one row in the second stage, an empty table gives
an empty table, and further columns of ``documents`` come through as they are, whatever their names. Ties are told at each
operator.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from curbside.llm import decontamination, exact_dedup, quality, sentencepiece_codec, simhash
from curbside.llm.common import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.kept(docs, _table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the largest doc_id; rows are judged by their texts, whatever ids they share."""
    return exact_dedup.kept(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest doc_id."""
    return simhash.kept(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests that show the round trip."""
    return sentencepiece_codec.encoded(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: A trained classifier, XXH64 fingerprints, edit distances and unigram paths are beyond SQL; see tests/llm.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the whole of ``documents``. What a stage wrote is removed when the next one has read it; the
    last one's table stays for the caller."""
    docs, before = _table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/corpus-{uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return docs
