"""From raw documents to packed training sequences, in five stages; each works on what the stage before has kept.

All stages but the last return the columns of documents. n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm import language, near_copies, packing, repeats, secrets
from deltaweave.llm.common import free_name, shared_folder

LEAST_SCORE = 0.5
#: Learned models, digests of token ids and the choice of sequences are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a score of at least LEAST_SCORE; texts that are null or without letters go."""
    learn = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    model = language.fit(learn.filter(~language.held_out() & F.col("doc_id").isNotNull()))
    lang, score = (free_name(docs, x) for x in ("lang_pred", "score"))
    kept = language.with_language(docs, model, names=(lang, score)).filter((F.col(lang) != language.UNKNOWN) & (F.col(score) >= LEAST_SCORE))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is alike in at least 0.8 of its five-word shingles."""
    return near_copies.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of over 50 words that repeat in what is left."""
    return _counted(repeats.drop_passages(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return _counted(secrets.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 4096 tokens."""
    return packing.packed_documents(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What one stage returns is written to the shared checkpoint folder and read again by the next, and goes when that is done.

    The last stage's result rests on checkpoints of its own, so nothing of the folder is needed after it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{before}"), True)
        before = name
    out = STAGES[-1][1](spark, docs, sf_dir)
    files.delete(at, True)
    return out
