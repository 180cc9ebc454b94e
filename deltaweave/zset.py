"""Weighted rows: a change is a DataFrame whose rows carry a signed count in `_weight`, last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEIGHT = "_weight"


def lift(df: DataFrame, weight: int = 1) -> DataFrame:
    """Plain rows as a change that inserts each (or, with -1, retracts it)."""
    return df.withColumn(WEIGHT, F.lit(weight).cast("long"))


def columns(z: DataFrame) -> list[str]:
    return [c for c in z.columns if c != WEIGHT]


def negate(z: DataFrame) -> DataFrame:
    return z.withColumn(WEIGHT, -F.col(WEIGHT))


def merge(*zs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), zs)


def consolidate(z: DataFrame) -> DataFrame:
    """One row for each distinct row, with its net weight; none where that is zero."""
    return z.groupBy(*columns(z)).agg(F.sum(WEIGHT).alias(WEIGHT)).filter(F.col(WEIGHT) != 0)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """The change from one weighted state to another."""
    return consolidate(merge(negate(old), new))


def expand(z: DataFrame) -> DataFrame:
    """Plain rows, each as often as its net weight says. A negative net weight is an error: more was retracted than there was."""
    checked = F.when(F.col(WEIGHT) < 0, F.raise_error(F.lit("invalid multiplicity: more rows were retracted than exist"))).otherwise(F.col(WEIGHT).cast("int"))
    return consolidate(z).withColumn("_copies", F.explode(F.array_repeat(F.lit(1), checked))).select(*columns(z))


def rows_with_keys(z: DataFrame, keys: list[str], touched: DataFrame) -> DataFrame:
    """Rows whose keys are among those of `touched`; null keys match null keys."""
    want = touched.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)]).distinct()
    return z.join(want, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_t{i}")) for i, k in enumerate(keys)]), "left_semi")
