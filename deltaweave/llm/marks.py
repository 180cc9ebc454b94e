"""Bit maps of fixed size over keys, which tell rows that surely aren't needed before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

SPOTS = 1 << 24
_ROW = 4096  # bits of one row of the table


class Marks:
    """A bit map of SPOTS bits for the values of some columns: a table of at most 4096 rows and about 2 MB, which may be broadcast."""

    def __init__(self, keys: DataFrame, *columns: str):
        self.columns = columns
        spots = keys.select(self._spot().alias("p"))
        words = spots.groupBy(F.expr("cast(p div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("x"))
        rows = words.groupBy(F.expr("w div 64").alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr("w % 64").alias("k"), "x"))).alias("m"))
        self.rows = checkpoint(rows.select("_row", F.expr("transform(sequence(0, 63), k -> coalesce(m[k], 0L))").alias("_bits")))

    def _spot(self) -> Column:
        return F.pmod(F.xxhash64(*self.columns), F.lit(SPOTS)).cast("int")

    def on(self, df: DataFrame, name: str) -> DataFrame:
        """`df` with a column that is true for all rows whose values are among the keys, and by chance for some others."""
        bit = F.expr(f"shiftright(_bits[cast(_spot % {_ROW} div 64 as int)], _spot % 64) & 1L") == 1
        met = df.withColumn("_spot", self._spot()).join(F.broadcast(self.rows), F.expr(f"_spot div {_ROW} = _row"), "left")
        return met.withColumn(name, F.coalesce(bit, F.lit(False))).drop("_spot", "_row", "_bits")
