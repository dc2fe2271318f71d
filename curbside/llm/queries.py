"""The operators of this subpackage bound to the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm import alignment, decontamination, exact_dedup, html_text, lexical, minhash, quality, secrets, sentencepiece_codec, simhash, suffix_dedup, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), token_counts.model_path(spark))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(_table(spark, sf_dir, "pages"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encoded(_table(spark, sf_dir, "documents"), token_counts.model_path(spark), remembered=(400_000, 400_000))
    digest = F.sha2("ids", 256).alias("ids_sha256")
    return coded.select("doc_id", "n_pieces", "n_bytes", digest, "text_sha256", "decoded_sha256", "round_trip")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.decisions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(_table(spark, sf_dir, "documents"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_suffix_array_dedup,
        op2_token_counts,
        op3_html_extraction,
        op4_secret_scan,
        op5_exact_dedup,
        op6_decontamination,
        op7_sentencepiece,
        op8_quality_classifier,
        op9_toxicity,
        op10_simhash_near_dedup,
        op11_token_alignment,
        op12_minhash_near_dedup,
        op13_lexical_search,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_array_dedup": suffix_dedup.ORACLE_SQL, "op5_exact_dedup": exact_dedup.ORACLE_SQL, "op13_lexical_search": lexical.ORACLE_SQL}
