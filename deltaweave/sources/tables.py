"""Sources: generated rows, JSON and change records, and the folder that intermediate tables go to."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.zset import WEIGHT


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share. Only a local session may go without; elsewhere that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/deltaweave-checkpoints"
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def generate_rows(spark: SparkSession, n: int, groups: int = 5) -> DataFrame:
    """Synthetic (a, b) rows as insertions."""
    return spark.range(n).select(F.col("id").alias("a"), (F.col("id") % groups).alias("b"), F.lit(1).cast("long").alias(WEIGHT))


def json_rows(lines: DataFrame, column: str, schema: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, dead letters) of JSON arrays bound by place or objects bound by name. Strict: a bad line is an error when it is read."""
    names = [x.split()[0] for x in schema.split(",")]
    types = [x.split(None, 1)[1] for x in (y.strip() for y in schema.split(","))]
    by_place = F.from_json(column, "array<string>")
    by_name = F.from_json(column, schema)
    placed = F.struct(*[F.try_element_at(by_place, F.lit(i + 1)).cast(t).alias(n.strip()) for i, (n, t) in enumerate(zip(names, types, strict=True))])
    is_array = F.ltrim(F.col(column)).startswith("[")
    good = F.when(is_array, F.size(by_place) == len(names)).otherwise(F.try_parse_json(column).isNotNull())
    parsed = lines.select("*", F.when(is_array, placed).otherwise(by_name).alias("_row"), F.coalesce(good, F.lit(False)).alias("_good"))
    if strict:
        parsed = parsed.withColumn("_good", F.when(F.col("_good"), True).otherwise(F.raise_error(F.concat(F.lit("cannot decode "), F.col(column)))))
    return parsed.filter("_good").select("_row.*"), parsed.filter("not _good").select(column)


def cdc_changes(records: DataFrame) -> DataFrame:
    """A weighted change from change records (op, before, after): insert +new, delete -old, update both."""
    sides = F.filter(F.array(F.struct(F.col("before").alias("r"), F.lit(-1).cast("long").alias("w")), F.struct(F.col("after").alias("r"), F.lit(1).cast("long").alias("w"))), lambda x: x["r"].isNotNull())
    return records.select(F.explode(sides).alias("x")).select("x.r.*", F.col("x.w").alias(WEIGHT))
