"""Near-duplicate groups by SimHash and covering locality-sensitive hashing.

For radius r there are 2^(r+1)-1 bit masks. Bit i of a fingerprint has a non-zero vector of r+1 bits, and mask v keeps the
bits whose vector has an odd number of bits in common with v. Any r differing bits have r vectors, and some v other than
zero is orthogonal to all of them: under that mask the two fingerprints are equal. So every pair within the radius meets in
some table; none is left to chance.

Only distinct fingerprints are linked; documents share their fingerprint's group. A bucket of up to BUCKET fingerprints is
compared block by block and gives one or two links for each member. A larger bucket is split by all choices of r of the
bits that its mask leaves out: fingerprints equal but for those r bits are within the radius of each other, at most 2^r of
them can be, and every linked pair of the bucket is equal but for some choice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_coding import parts, release
from .common import checkpoint, id_text, in_batches
from .components import components

BITS = 64
BUCKET = 8192
ROWS = 128


def fingerprint_many(texts: list[bytes], shingle: int, seed: int = 42) -> np.ndarray:
    """A signed 64-bit fingerprint for each text (UTF-8)."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    sizes = []
    for text in texts:
        words = text.lower().split()  # of bytes: A-Z, and the blanks 0x20 and 0x09 to 0x0D
        before = len(hashes)
        if len(words) >= shingle:
            hashes += [digest(b" ".join(x), seed) for x in zip(*(words[k:] for k in range(shingle)))]
        elif words:
            hashes.append(digest(b" ".join(words), seed))
        sizes.append(len(hashes) - before)
    n = np.array(sizes, dtype=np.int64)
    out = np.zeros(len(texts), dtype=np.int64)
    if hashes:
        some = np.flatnonzero(n)
        starts = np.cumsum(n[some]) - n[some]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * counts > n[some, None], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; a text without words, or null, has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in parts(batch):
                for at in range(0, part.num_rows, 64):
                    piece = part.slice(at, 64)
                    yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fingerprint_many(piece.column("text").cast(pa.binary()).to_pylist(), shingle))], names=["doc_id", "fp"])

    return id_text(docs, id_col, text_col).transform(in_batches, run, "doc_id long, fp long")


def masks(radius: int, bits: int = BITS) -> list[int]:
    """The covering masks, as signed 64-bit numbers."""
    n = (2 << radius) - 1
    made = [sum(1 << i for i in range(bits) if ((1 + i % n) & v).bit_count() % 2) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in made]


def _blocks(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The differing bits of each member and all others, some rows at a time."""
    for at in range(0, len(x), ROWS):
        yield at, np.bitwise_count((x[at : at + ROWS, None] ^ x[None, :]).view(np.uint64))


def _within(values: list[int], radius: int) -> tuple[list[int], list[int]]:
    """For the members of one bucket that are linked: each and the least member of its group in the bucket."""
    x = np.sort(np.array(values, dtype=np.int64))
    group = np.arange(len(x))
    while True:
        least = group.copy()
        for at, far in _blocks(x):
            least[at : at + ROWS] = np.where(far <= radius, group[None, :], len(x)).min(axis=1)
        least = least[least]
        if (least == group).all():
            break
        group = least
    moved = np.flatnonzero(group != np.arange(len(x)))
    return x[moved].tolist(), x[group[moved]].tolist()


def _direct(values: list[int], radius: int) -> tuple[list[int], list[int]]:
    """Links between members of one bucket that are within the radius themselves: each to its nearest and to its least such member."""
    x = np.sort(np.array(values, dtype=np.int64))
    ends: list[list[int]] = [[], []]
    for at, far in _blocks(x):
        rows = np.arange(len(far))
        far[rows, at + rows] = 255  # not to itself
        near = far <= radius
        some = np.flatnonzero(near.any(axis=1))
        for to in (near[some].argmax(axis=1), far[some].argmin(axis=1)):
            ends[0] += x[at + some].tolist()
            ends[1] += x[to].tolist()
    return ends[0], ends[1]


def link_fingerprints(distinct: DataFrame, radius: int = 2, bucket: int = BUCKET, direct: bool = False) -> DataFrame:
    """Links (f, a, b) between the distinct values of `fp` with equal `f` that lead from each to all within `radius` of it.

    `direct`: every link is itself within the radius; a link of the others may be a chain of such.
    """
    kept = masks(radius)
    tables = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.xxhash64("f", F.lit(v), F.col("fp").bitwiseAND(F.lit(m))).alias("key")) for v, m in enumerate(kept)]))
    keys = distinct.select("f", "fp", tables.alias("t")).select("f", "fp", "t.v", "t.key")
    # a table of its own, so that a hot key's rows can be split in the join
    sized = checkpoint(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    met = keys.join(sized, "key")
    links = _direct if direct else _within

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ends = [links(list(x), radius) for x in frame["fps"]]
            yield pd.DataFrame({"f": np.repeat(frame["f"].to_numpy(), [len(x) for x, _ in ends]), "a": [i for x, _ in ends for i in x], "b": [i for _, y in ends for i in y]}, dtype="int64")

    few = met.filter(F.col("n") <= bucket).groupBy("key").agg(F.first("f").alias("f"), F.collect_list("fp").alias("fps")).select("f", "fps").mapInPandas(compare, "f long, a long, b long")
    free = [[i for i in range(BITS) if not (m >> i) & 1] for m in kept]
    wild = [[~sum(1 << i for i in c) for c in combinations(z, radius)] for z in free]
    wild = [[w + (1 << 64) if w < -(1 << 63) else w for w in ws] for ws in wild]
    choices = F.element_at(F.array(*[F.array(*[F.lit(w) for w in ws]) for ws in wild]), F.col("v") + 1)
    dealt = met.filter(F.col("n") > bucket).select("f", "fp", F.explode(choices).alias("w"))
    alike = dealt.groupBy("f", "w", F.col("fp").bitwiseAND(F.col("w")).alias("rest")).agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    many = alike.select(F.col("f").cast("long").alias("f"), F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a <> b")
    return few.unionByName(many)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row: component_id is the least doc_id that links of at most `radius` differing bits reach.

    Empty and null texts have fingerprint 0 and link like others. Repeated rows each keep their row. A null doc_id keeps its
    row and never names a component unless all its members' ids are null. Other columns are not read.
    """
    prints = checkpoint(fingerprints(docs, shingle, id_col, text_col))
    lowest = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(link_fingerprints(lowest.select(F.lit(0).alias("f"), "fp"), radius, bucket))
    rooted = lowest.join(roots, lowest["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("own"), "component_id")
    return prints.join(named, prints["fp"] == named["own"], "left").select("doc_id", "fp", "component_id")


def fingerprint_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) with the fingerprint as 16 hex digits."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
