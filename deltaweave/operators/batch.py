"""Operators over plain rows, where they are more than one call of the DataFrame API."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaweave.sources.tables import shared_folder
from deltaweave.zset import WEIGHT


def null_aware_anti(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """NOT IN: nothing if the right side has a null; all of the left if it is empty; else left rows with a known key that isn't there."""
    keys = right.select(F.col(right_key).alias("_k"))
    facts = keys.agg(F.count("*").alias("_n"), F.count_if(F.col("_k").isNull()).alias("_nulls"))  # one row
    kept = left.join(keys.distinct(), F.col(left_key) == F.col("_k"), "left_anti").crossJoin(F.broadcast(facts))
    return kept.filter((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(left_key).isNotNull())).drop("_n", "_nulls")


def top_k(df: DataFrame, k: int, order: Sequence[Column], partition_by: Sequence[str] = ()) -> DataFrame:
    """The first k rows of each partition; ties by all columns, so the choice is always the same."""
    plain = [F.col(f.name) for f in df.schema if not isinstance(f.dataType, T.MapType)]
    if not partition_by:
        return df.orderBy(*order, *plain).limit(k)
    rank = F.row_number().over(Window.partitionBy(*partition_by).orderBy(*order, *plain))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def factorized_join_agg(left: DataFrame, right: DataFrame, key: str, value: str, group: str) -> DataFrame:
    """(group, total, n): SUM(left.value) and COUNT(*) of an inner join, by a column of the right side, without its pairs.

    Either side is reduced to one row for each key (and group) before the join.
    """
    a = left.groupBy(key).agg(F.sum(value).alias("_s"), F.count("*").alias("_l"))
    b = right.groupBy(key, group).agg(F.count("*").alias("_r"))
    return a.join(b, key).groupBy(group).agg(F.sum(F.col("_s") * F.col("_r")).alias("total"), F.sum(F.col("_l") * F.col("_r")).alias("n"))


def salted_agg(df: DataFrame, keys: Sequence[str], value: str, buckets: int = 16) -> DataFrame:
    """(keys, total, n) in two phases: hot keys are split over `buckets`, and the parts combined."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(buckets)).alias("_b")
    part = df.select("*", salt).groupBy(*keys, "_b").agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    return part.groupBy(*keys).agg(F.sum("_s").alias("total"), F.sum("_n").alias("n"))


def unnest(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row for each element in place of the array; a null or empty array gives none."""
    return df.select(*[c for c in df.columns if c != column], F.explode(column).alias(name))


def generate_series(df: DataFrame, start: Column, stop: Column, step: int, name: str) -> DataFrame:
    """Both ends included; nothing if the step leads away from the end."""
    if step == 0:
        raise ValueError("step size cannot be zero")
    runs = (start <= stop) if step > 0 else (start >= stop)
    return df.select("*", F.explode(F.when(runs, F.sequence(start, stop, F.lit(step).cast("long")))).alias(name))


def json_array(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row of JSON text for each element; strings keep their quotes. A null or empty array gives none; what isn't an array is an error."""
    items = F.from_json(F.concat(F.lit('{"a":'), F.col(column), F.lit("}")), "a array<variant>", {"mode": "FAILFAST"})["a"]
    return df.select("*", F.explode(items).alias("_v")).withColumn(name, F.to_json(F.col("_v"))).drop("_v")


def tumble(df: DataFrame, ts: str, size: str, name: str = "window_start") -> DataFrame:
    """Each row with the start of its window; rows without a time go."""
    return df.filter(F.col(ts).isNotNull()).withColumn(name, F.window(F.col(ts).cast("timestamp_ntz"), size)["start"])


def hop(df: DataFrame, ts: str, size: str, slide: str, name: str = "window_start") -> DataFrame:
    """Each row once for each window that holds it."""
    return df.filter(F.col(ts).isNotNull()).withColumn("_w", F.window(F.col(ts).cast("timestamp_ntz"), size, slide)).withColumn(name, F.col("_w.start")).drop("_w")


def sessions(df: DataFrame, keys: Sequence[str], ts: str, gap: str) -> DataFrame:
    """(keys, session_start, session_end, n); a session ends with its last event."""
    stamped = df.filter(F.col(ts).isNotNull()).withColumn("_t", F.col(ts).cast("timestamp_ntz"))
    out = stamped.groupBy(*keys, F.session_window("_t", gap).alias("_s")).agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count("*").alias("n"))
    return out.drop("_s")


def fixed_point(base: DataFrame, step: Callable[[DataFrame], DataFrame], checkpoint: Callable[[DataFrame], DataFrame], max_iterations: int = 100) -> DataFrame:
    """All rows that `step` leads to from `base`, without repeats; cycles end it. Each round looks only at the rows that are new."""
    found = new = checkpoint(base.distinct())
    for _ in range(max_iterations):
        fresh = checkpoint(step(new).distinct().exceptAll(found).distinct())
        if fresh.isEmpty():
            return found
        found, new = checkpoint(found.unionByName(fresh)), fresh
    raise RuntimeError(f"no fixed point after {max_iterations} rounds")


def bloom(df: DataFrame, column: str, bits: int = 256, hashes: int = 3) -> DataFrame:
    """One row: `bits`, the set positions of a Bloom filter over the column."""
    spots = F.array(*[F.pmod(F.xxhash64(F.lit(i), F.col(column)), F.lit(bits)) for i in range(hashes)])
    return df.filter(F.col(column).isNotNull()).select(F.explode(spots).alias("p")).agg(F.array_sort(F.collect_set("p")).alias("bits"))


def might_contain(filter_bits: Column, value: Column, bits: int = 256, hashes: int = 3) -> Column:
    return F.forall(F.array(*[F.pmod(F.xxhash64(F.lit(i), value), F.lit(bits)) for i in range(hashes)]), lambda p: F.array_contains(filter_bits, p))


def chunk_numbers(df: DataFrame, key: str, batch_size: int, checkpoint: Callable[[DataFrame], DataFrame], then: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """All rows with their chunk of `batch_size` as `_chunk`, in order of `key`, nulls first, and how many rows there are.

    Rows with equal keys are in order of the columns `then`, nulls last, and after these of a hash of all their columns, so a row is in
    the same chunk whenever the same table is read again. A key of any type that has an order will do. Only the number of rows in each
    range comes to the driver; the table is sorted once, however many chunks there are.
    """
    named = df.withColumn("_h", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    order = [F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_last() for c in then], F.col("_h")]
    ranged = named.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = checkpoint(ranged.drop("_h"))
    part = F.shiftright("_at", 33)  # the id is the partition's number and, in the lower 33 bits, the row's place in it
    counts = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [0], 0
    for p in range(max(counts, default=-1) + 1):
        total += counts.get(p, 0)
        before.append(total)
    offset = F.get(F.array(*[F.lit(n).cast("long") for n in before]), part.cast("int"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + offset
    return ranged.withColumn("_chunk", F.floor(place / batch_size)).drop("_at"), total


def snapshot_chunks(df: DataFrame, key: str, batch_size: int, checkpoint: Callable[[DataFrame], DataFrame], resume_from: int = 0, then: Sequence[str] = ()):
    """The chunks of `chunk_numbers` one by one, as +1 changes, from chunk `resume_from` on.

    Each is a folder of its own below spark.checkpoint.dir (of types that Parquet can hold), so reading one reads no other.
    """
    placed, total = chunk_numbers(df, key, batch_size, checkpoint, then)
    if resume_from * batch_size >= total:
        return
    folder = f"{shared_folder(df.sparkSession)}/chunks-{uuid.uuid4().hex}"
    placed.filter(F.col("_chunk") >= resume_from).write.partitionBy("_chunk").parquet(folder)
    for i in range(resume_from, -(-total // batch_size)):
        yield i, df.sparkSession.read.schema(df.schema).parquet(f"{folder}/_chunk={i}").withColumn(WEIGHT, F.lit(1).cast("long"))


def factorized_avg(left: DataFrame, right: DataFrame, key: str, value: str, group: str) -> DataFrame:
    """(group, total, n, average): as `factorized_join_agg`, with SUM, COUNT and AVG of the values that aren't null."""
    a = left.groupBy(key).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    b = right.groupBy(key, group).agg(F.count("*").alias("_r"))
    sums = a.join(b, key).groupBy(group).agg(F.sum(F.col("_s") * F.col("_r")).alias("total"), F.sum(F.col("_c") * F.col("_r")).alias("n"))
    return sums.withColumn("average", F.col("total") / F.nullif("n", F.lit(0)))
