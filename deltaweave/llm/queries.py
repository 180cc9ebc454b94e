"""The registered queries of the training-data operators, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_coding import coding_digests
from .common import documents
from .language import held_out_language
from .neighbours import nearest_embeddings
from .packing import packed_documents
from .repeats import repeat_digests
from .secrets import secret_digests
from .simhash import fingerprint_components
from .token_counts import token_counts

from .toxicity import labelled_severity
from .weighted_sampling import edited_fingerprints


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op3_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding_digests(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_components(documents(spark, sf_dir))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(documents(spark, sf_dir))


def op9_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_language(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_severity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
