"""Groups of documents whose word shingles are alike: SimHash groups first, then what they miss, found exactly by prefixes.

A fingerprint weighs a shingle by how often it is in the text. So texts of one SimHash group (see `simhash`) are joined if their
shingles are alike with repeats counted; no other step finds these. Then all texts are joined whose sets of shingles are alike,
whatever their fingerprints; what the SimHash groups have joined is not compared again.

Both comparisons are exact, and find every pair: all sets are sorted in one order of the shingles: those that are common in a sample
come last, by how common they are, all others by their hash (a shingle's repeats, which count as shingles of their own, come behind
them all). Two sets of at least the Jaccard similarity s share a shingle among the first
n - ceil(s * n) + 1 of each (n its size), so every such pair meets at a shingle; none is left to chance, and the sample decides only
how many others meet. Of the texts that meet at a shingle, each is first compared with a central one, at whose place in the order
the least shingles come before; in the second round, with a central one of the largest group there so far. That joins nearly all of a
large group. Then every pair that meets and isn't yet joined is compared as well.

No group is ever gathered: texts that meet are joined with one of them, or, where they are in different groups, those outside
the shingle's largest group with the others. Which texts are needed is asked of bit maps of fixed size first (`Marks`), so that
nearly all others are never shuffled; what a bit map lets through is looked up exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import join_hashes
from .bpe_coding import parts, release
from .common import checkpoint, in_batches
from .components import components
from .marks import Marks
from .simhash import near_duplicates

NULL_ID = -(1 << 63)
SHARE = 12  # of so many texts, one is in the sample whose common shingles come last in the order
COMMON = 100_000  # at most so many of them
SKETCH = 64  # words of 64 bits
ROUNDS = 2  # of comparisons with central texts
TURNS = 4  # so many choices, by the shingle, among texts that are equally central


def shingle_set(text: bytes, words: int, counted: bool = False) -> np.ndarray:
    """The hashes of a text's different word shingles, sorted; a shorter text is one shingle, and so is one without words.

    `counted`: with a further hash for each time that a shingle is there again, made of its own and how often it came before.
    """
    import xxhash

    w = text.lower().split()
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], dtype=np.uint64).view(np.int64)
    known = {x: xxhash.xxh64_intdigest(x, 42) for x in set(w)}
    h = np.array([known[x] for x in w], dtype=np.uint64)
    n = len(w) - words + 1
    made = h[:n].copy()
    for k in range(1, words):
        made = join_hashes(made, h[k : n + k])
    if counted:
        made.sort()
        before = (np.arange(n) - np.searchsorted(made, made)).astype(np.uint64)
        made = np.where(before > 0, join_hashes(made, before), made)
    return np.unique(made.view(np.int64))


def prefix(shingles: np.ndarray, similarity: float, common: np.ndarray, ranks: np.ndarray, plain: np.ndarray | None = None) -> np.ndarray:
    """The first shingles of a set in the order of all; `common` is sorted, `ranks` are from 1. What is not in `plain`, if given, is a repeat."""
    rank = np.zeros(len(shingles), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rank = np.where(common[at] == shingles, ranks[at], 0)
    if plain is not None:
        rank = np.where(np.isin(shingles, plain), rank, COMMON + 1)
    n = len(shingles) - ceil(len(shingles) * similarity - 1e-9) + 1
    return shingles[np.lexsort((shingles, rank))[:n]]


def common_shingles(keyed: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that several texts of a sample have, sorted, and how common they are among them, as a rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in parts(batch, "body"):
                yield pa.RecordBatch.from_arrays([pa.array([shingle_set(t, words) for t in part.column("body").to_pylist()], pa.list_(pa.int64()))], names=["s"])

    sample = keyed.filter(F.pmod("tk", F.lit(SHARE)) == 0).select("tk", "body").dropDuplicates(["tk"]).select("body")
    counted = sample.transform(in_batches, run, "s array<long>").select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("c")).filter("c > 3")
    found = counted.orderBy(F.col("c").desc(), "s").limit(COMMON).select("s").toArrow().column("s").to_numpy()
    order = np.argsort(found)
    return found[order], len(found) - order


def may_be_alike(a: Column, b: Column, similarity: float) -> Column:
    """Whether sets of sizes n whose first common shingle may be at the places i can be alike."""
    more = F.least(a["n"] - a["i"], b["n"] - b["i"])
    return more * (1 + similarity) + 1e-6 >= (a["n"] + b["n"]) * similarity


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SKETCH words of 64 bits: each shingle turns one bit over. So two sketches differ in at most as many bits as the sets have members that the other lacks."""
    spots = shingles.view(np.uint64) % np.uint64(64 * SKETCH)
    return np.packbits((np.bincount(spots.astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)).view(np.int64)


def alike(some: DataFrame, keyed: DataFrame, texts: DataFrame, words: int, similarity: float, best: bool = False, counted: bool = False) -> DataFrame:
    """Those of the pairs (a, b) of texts that are alike, as nodes. Pairs that differ too much by their sketches alone go first; of the others the sets are compared.

    `best`: only the pair of each a whose sketches differ least. `counted`: repeats count as well.
    """

    def made(pairs: DataFrame, of_set) -> DataFrame:
        """(tk, c, s) of the pairs' texts: the number of shingles and an array made of them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for batch in batches:
                for part in parts(batch, "body"):
                    sets = [shingle_set(t, words, counted) for t in part.column("body").to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column("tk"), pa.array([len(x) for x in sets], pa.int32()), pa.array([of_set(x) for x in sets], pa.list_(pa.int64()))], names=["tk", "c", "s"])

        # of equal texts the one with the least id; what slips in meets no pair
        own = pairs.select(F.explode(F.array("a", "b")).alias("tk")).distinct().join(texts, "tk").select("tk", "kid")
        needed = Marks(own, "kid", "tk").on(keyed.select("kid", "tk", "body"), "m").filter("m").select("tk", "body")
        return checkpoint(needed.transform(in_batches, run, "tk long, c int, s array<long>").groupBy("tk").agg(F.first("c").alias("c"), F.first("s").alias("s")))

    def both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        one, other = (sets.select(F.col("tk").alias(x), F.col("c").alias(f"c{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
        return pairs.join(one, "a").join(other, "b")

    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    size = F.col("ca") + F.col("cb")
    possible = both(some, made(some, sketch)).select("a", "b", size.alias("size"), differ.alias("differ")).filter(F.col("size") - F.col("differ") + 1e-6 >= (F.col("size") + F.col("differ")) * similarity)
    if best:
        possible = possible.groupBy("a").agg(F.min(F.struct(F.col("differ") / F.col("size"), "b")).alias("x")).select("a", "x.b")
    possible = checkpoint(possible.select("a", "b"))
    shared = F.size(F.array_intersect("sa", "sb"))
    found = both(possible, made(possible, lambda x: x)).select("a", "b", shared.alias("c"), (size - shared).alias("e")).filter(F.col("c") >= F.col("e") * similarity)
    node = texts.select("tk", F.struct("kid", "tk").alias("node"))
    found = found.join(node.select(F.col("tk").alias("a"), F.col("node").alias("na")), "a").join(node.select(F.col("tk").alias("b"), F.col("node").alias("nb")), "b")
    return checkpoint(found.select(F.col("na").alias("a"), F.col("nb").alias("b")))


def print_groups(keyed: DataFrame, words: int) -> DataFrame:
    """(g, tk): the texts of each SimHash group that has several different ones."""
    groups = near_duplicates(keyed.select("tk", "body"), words, id_col="tk", text_col="body")
    others = checkpoint(groups.filter("doc_id <> component_id").select(F.col("component_id").alias("g"), F.col("doc_id").alias("tk")).distinct())
    return others.unionByName(others.select("g", F.col("g").alias("tk")).distinct())


def meetings(keyed: DataFrame, texts: DataFrame, words: int, similarity: float, common: Broadcast, groups: DataFrame | None = None) -> DataFrame:
    """(s, tk, n, i): for each shingle s that several different texts have in their prefixes, the texts, their numbers of shingles, and where it stands.

    `groups`: texts meet only within them, and repeats count.
    """
    counted = groups is not None
    if groups is not None:
        keyed = Marks(groups, "tk").on(keyed.select("tk", "body"), "p").filter("p")  # what slips in is in no group

    def heads_of(texts: list[bytes], sets: list[np.ndarray]) -> list[np.ndarray]:
        return [prefix(s, similarity, *common.value, plain=shingle_set(t, words) if counted else None) for t, s in zip(texts, sets)]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in parts(batch, "body"):
                bodies = part.column("body").to_pylist()
                sets = [shingle_set(t, words, counted) for t in bodies]
                heads = pa.array(heads_of(bodies, sets), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("tk"), part.column("m"), pa.array([len(s) for s in sets], pa.int32()), heads], names=["tk", "m", "n", "head"])

    marked = Marks(texts.filter("copies > 1"), "tk").on(keyed.select("tk", "body"), "m")
    headed = checkpoint(marked.transform(in_batches, first, "tk long, m boolean, n int, head array<long>"))
    once = headed.filter("m").groupBy("tk").agg(F.first("n").alias("n"), F.first("head").alias("head"))
    headed = headed.filter("not m").select("tk", "n", "head").unionByName(once)
    each = headed.select(F.posexplode("head").alias("i", "s"), "tk", "n")
    if groups is not None:
        each = each.join(groups, "tk").select("i", F.xxhash64("g", "s").alias("s"), "tk", "n")
    several = checkpoint(each.groupBy("s").agg(F.count("*").alias("c")).filter("c > 1").select("s"))
    return checkpoint(each.join(several, "s").select("s", "tk", "n", "i"))


def with_roots(met: DataFrame, links: DataFrame) -> DataFrame:
    """`met` with the group that each text is in so far."""
    roots = components(links).select(F.col("node.tk").alias("tk"), F.col("root.tk").alias("root"))
    return met.join(roots, "tk", "left").withColumn("root", F.coalesce("root", "tk"))


def mixed_meetings(placed: DataFrame) -> DataFrame:
    """The rows of `placed` at shingles whose texts are in several groups, with the largest of these (of equals the last) as `main`."""
    sizes = placed.groupBy("s", "root").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("s").agg(F.max(F.struct("c", "root")).alias("x"), F.count("*").alias("groups")).filter("groups > 1")
    return checkpoint(placed.join(checkpoint(largest.select("s", F.col("x.root").alias("main"))), "s"))


def central_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each text a outside a shingle's main group, or where there is none each, and the most central text b of it, where that is in another group."""
    outside = F.col("root") != F.col("main") if "main" in met.columns else F.lit(False)
    order = F.struct(outside.alias("outside"), "i", F.xxhash64("tk", F.pmod("s", F.lit(TURNS))).alias("o"), "tk", "n", "root")
    hubs = checkpoint(met.groupBy("s").agg(F.min(order).alias("x")))
    asking = met.filter(outside) if "main" in met.columns else met
    near = asking.select("s", F.struct("tk", "n", "i", "root").alias("y")).join(hubs, "s")
    return near.filter((F.col("x.root") != F.col("y.root")) & may_be_alike(F.col("x"), F.col("y"), similarity)).select(F.col("y.tk").alias("a"), F.col("x.tk").alias("b"))


def crossed_pairs(mixed: DataFrame, similarity: float) -> DataFrame:
    """(a, b): every pair that meets at a shingle and is not in one group. Each text outside a shingle's main group is joined with all others there."""
    one = mixed.filter("root <> main").select("s", F.struct("tk", "n", "i", "root").alias("x"))
    other = mixed.select("s", F.struct("tk", "n", "i", "root", (F.col("root") == F.col("main")).alias("main")).alias("y"))
    apart = (F.col("x.root") != F.col("y.root")) & (F.col("y.main") | (F.col("x.tk") > F.col("y.tk"))) & may_be_alike(F.col("x"), F.col("y"), similarity)
    met = one.join(other, (one["s"] == other["s"]) & apart)
    return met.select(F.greatest("x.tk", "y.tk").alias("a"), F.least("x.tk", "y.tk").alias("b"))


def linked(met: DataFrame, keyed: DataFrame, texts: DataFrame, words: int, similarity: float, links: DataFrame | None = None, counted: bool = False) -> DataFrame:
    """`links`, and links that join all texts which meet and are alike. What is joined already is not compared."""
    for k in range(ROUNDS + 1):
        placed = met.withColumn("root", F.col("tk")) if links is None else with_roots(met, links)
        if k:
            placed = mixed_meetings(placed)
            if placed.isEmpty():
                break
        pairs = checkpoint((crossed_pairs(placed, similarity) if k == ROUNDS else central_pairs(placed, similarity)).distinct())
        if links is not None and pairs.isEmpty():
            continue
        found = alike(pairs, keyed, texts, words, similarity, best=k < ROUNDS, counted=counted)
        links = found if links is None else links.unionByName(found)
    return links


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group: the least id (nulls first), of rows with equal ids the least hash of the text.

    Groups are what pairs of at least `similarity` join: of the sets of shingles, or within a SimHash group with repeats counted. A null text counts as empty. Texts without words are alike. Repeated
    rows are one group. An empty table gives an empty one.
    """
    names = docs.columns
    kid, text = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), kid.alias("kid"), F.xxhash64(text).alias("tk"), text.cast("binary").alias("body"))
    spark = docs.sparkSession
    # equal texts are one node, named by its least id; its text is that of the row with this id
    texts = checkpoint(keyed.groupBy("tk").agg(F.min("kid").alias("kid"), F.count("*").alias("copies")))
    common = spark.sparkContext.broadcast(common_shingles(keyed, words))  # two arrays of at most COMMON numbers
    groups, links = print_groups(keyed, words), None
    if not groups.isEmpty():
        links = linked(meetings(keyed, texts, words, similarity, common, groups), keyed, texts, words, similarity, counted=True)
    links = linked(meetings(keyed, texts, words, similarity, common), keyed, texts, words, similarity, links)
    gone = components(links).select("node.tk", F.lit(True).alias("gone"))
    judged = checkpoint(texts.join(gone, "tk", "left").filter("gone or copies > 1"))
    # rows whose texts have no copy stay; of the others the keys are judged exactly, and only rows that may be kept are looked up
    judging = Marks(judged, "tk")
    suspect = judging.on(keyed.select("kid", "tk"), "m").filter("m").select("kid", "tk").distinct()
    verdict = suspect.join(judged.select("tk", F.col("kid").alias("least"), F.coalesce("gone", F.lit(False)).alias("gone")), "tk", "left")
    kept = checkpoint(verdict.filter("least is null or (not gone and kid = least)").select("kid", "tk"))
    marked = Marks(kept, "kid", "tk").on(judging.on(keyed.select("row", "kid", "tk"), "judged"), "kept")
    first = marked.filter("judged and kept").groupBy("kid", "tk").agg(F.first("row").alias("row"))  # a repeated row of a text is the same row, so the first is any
    rows = marked.filter("not judged").select("row").unionByName(first.join(kept, ["kid", "tk"]).select("row"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in names])
