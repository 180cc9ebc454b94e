"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_cleared = [0.0]  # when let_go() was called last
ROWS = 1000  # of texts in a batch that goes to a Python worker


def vocabulary_path(name: str, path: str | None = None) -> str:
    """`path` itself, or where the installed public vocabularies keep `name`."""
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def broadcast_file(spark: SparkSession, path: str):
    """A vocabulary file's bytes, broadcast, and a key that names them. Vocabularies have a fixed size of at most a few MB."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{path} has {len(data)} bytes; a vocabulary of at most 64 MB is expected")
    return spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; a null text counts as empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share. A local session without one uses the machine's; on a cluster that would lose data, and is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/deltaweave-checkpoints"
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so that no executor's loss can undo it."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    out = without_huge_size(df.checkpoint(eager=True))
    if time.monotonic() > _cleared[0] + 1:
        let_go(spark)
    return out


def without_huge_size(made: DataFrame) -> DataFrame:
    """A checkpoint, with Spark's default estimate of its size if the one it was given is beyond 64 bits.

    Spark takes the product of both sides' sizes for a join, and a checkpoint keeps its plan's estimate. So in a chain of joins and
    checkpoints the digits of these numbers at least double with each, to hundreds of MB on the driver. Smaller estimates stay.
    """
    plan = made._jdf.logicalPlan()
    if plan.stats().sizeInBytes().bit_length() < 64:
        return made
    spark = made.sparkSession
    some, session = spark._jvm.scala.Option, spark._jsparkSession
    known = (plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream())
    bare = spark._jvm.org.apache.spark.sql.execution.LogicalRDD(*known, session, some.empty(), some.apply(plan.constraints()))
    return type(made)(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, bare), spark)


def let_go(spark: SparkSession) -> None:
    """Have Spark clear away the shuffle files of tables that nothing refers to any more; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _cleared[0] = time.monotonic()


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; before each, the worker gives memory back that it no longer uses, as executors keep their workers for the next operators."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        if trim is not None:
            trim(0)
        yield batch
        del batch
    if trim is not None:
        trim(0)


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with batches of at most ROWS rows: texts may be long, and both sides hold a batch in memory.

    That is a setting of the session, which is lowered where it is higher.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name)) not in range(1, ROWS + 1):
        conf.set(name, ROWS)
    return df.mapInArrow(lambda batches: run(tidy(batches)), schema)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many lines behind it as no column of `df` is called, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
