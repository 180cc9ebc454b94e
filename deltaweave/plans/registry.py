"""Registration of queries, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        for name in TABLES:
            if name in text:
                getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(text)


def query(name: str, sql: str | None = None):
    """Register a function of `Tables`."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query whose text is the engine's own SQL; `oracle` where the other dialect differs."""
    query(name, oracle or text)(lambda t: t.sql(text))
