"""Approximate nearest neighbours: a forest of random-projection trees, searched through one queue, and exact distances of what it finds.

The trees are fitted on a sample of about SAMPLE vectors, but every row is put into a leaf of each tree. A query goes down all
trees at once: a priority queue holds the nodes not yet visited of all trees by their margin, and the nearest is
next, until the leaves visited hold enough rows. Distances to the rows of these leaves are exact.

How many rows are enough depends on the data: some vectors lie in clusters, others are spread evenly and hard to separate by
any plane. It is measured: for PROBES of the vectors the exact neighbours are found by one pass over all rows, and the
budget is the least under which the forest finds the share RECALL of them.

Equal vectors are one entry with its k + 1 least ids: no more of them can be among the k nearest of anything. A leaf is
compared with its queries in blocks of bounded size, however many rows or queries it has.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

TREES = 8
SAMPLE = 10_000
LEAF = 24  # sampled vectors in a leaf
PROBES, RECALL = 64, 0.96
ROWS, QUERIES = 4096, 512  # of a block


class Forest:
    """Trees as arrays over all their nodes: inner nodes have a plane, leaves a number below zero."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.planes: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.sides: list[list[int]] = []
        self.leaves = 0
        self.roots = [self._grow(sample, np.arange(len(sample)), leaf, rng) for _ in range(trees)]
        dim = sample.shape[1]
        self.plane = np.array(self.planes, dtype=np.float64).reshape(-1, dim)
        self.offset, self.side = np.array(self.offsets), np.array(self.sides, dtype=np.int64).reshape(-1, 2)
        del self.planes, self.offsets, self.sides

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        """The node of `rows`: a plane between two of them, through the median, or a leaf."""
        if len(rows) <= leaf:
            return self._leaf()
        for _ in range(5):
            a, b = x[rng.choice(rows, 2, replace=False)].astype(np.float64)
            if (norm := np.linalg.norm(a - b)) > 0:
                plane = (a - b) / norm
                at = x[rows] @ plane
                middle = float(np.median(at))
                left = at < middle
                if 0 < left.sum() < len(rows):
                    node = len(self.planes)
                    self.planes.append(plane)
                    self.offsets.append(middle)
                    self.sides.append([0, 0])
                    self.sides[node] = [self._grow(x, rows[left], leaf, rng), self._grow(x, rows[~left], leaf, rng)]
                    return node
        return self._leaf()

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf (from 0) of each row in each tree."""
        out = np.empty((len(x), len(self.roots)), dtype=np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            while (inner := np.flatnonzero(node >= 0)).size:
                at = node[inner]
                above = np.einsum("ij,ij->i", x[inner], self.plane[at]) >= self.offset[at]
                node[inner] = self.side[at, above.astype(np.int64)]
            out[:, t] = -1 - node
        return out

    def search(self, q: np.ndarray, sizes: np.ndarray, least: int) -> list[int]:
        """Leaves that hold rows, in order of the margin by which the query misses them, until they hold `least` rows."""
        margins = self.plane @ q - self.offset
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        found, total = [], 0
        while queue and total < least:
            missed, node = heapq.heappop(queue)
            while node >= 0:
                m = margins[node]
                near, far = (self.side[node, 1], self.side[node, 0]) if m >= 0 else (self.side[node, 0], self.side[node, 1])
                heapq.heappush(queue, (max(missed, abs(float(m))), int(far)))
                node = int(near)
            if sizes[-1 - node]:
                found.append(-1 - node)
                total += int(sizes[-1 - node])
        return found


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def _budget(entries: DataFrame, placed: DataFrame, forest, sizes: np.ndarray, k: int, n: int, recall: float) -> int:
    """The least number of rows to visit with which the forest finds `recall` of the probes' neighbours."""
    rate = min(1.0, PROBES / n)
    probes = entries.filter(F.shiftrightunsigned(F.xxhash64(F.lit("probe"), "vid"), 11) / F.lit(float(1 << 53)) < rate).select("vid", "v").toPandas().sort_values("vid").head(2 * PROBES)
    if not len(probes):
        return int(sizes.sum())
    asked, names = _matrix(probes["v"]), probes["vid"].tolist()

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x, ids = _matrix(frame["v"]), frame["vid"].to_numpy()
                for name, q in zip(names, asked, strict=True):
                    d = distances(x, q)
                    kept = np.argpartition(d, min(k, len(d) - 1))[: k + 1]
                    yield pd.DataFrame({"qid": name, "vid": ids[kept], "score": d[kept]})

    best = Window.partitionBy("qid").orderBy("score", "vid")
    near = entries.select("vid", "v").mapInPandas(scan, "qid long, vid long, score double").filter("qid <> vid").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    near = near.join(placed, "vid").select("qid", "leaves").toPandas()  # k for each probe
    needed = []
    for name, q in zip(names, asked, strict=True):
        order = forest.search(q, sizes, int(sizes.sum()))
        seen = dict(zip(order, np.cumsum(sizes[order]).tolist(), strict=True))
        needed += [min(seen[x] for x in leaves) for leaves in near.loc[near["qid"] == name, "leaves"]]
    return int(np.quantile(needed, recall, method="higher")) if needed else int(sizes.sum())


def nearest(rows: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query's other rows, by Euclidean distance, ties to the lesser id.

    `is_query`: a condition on `rows`. Vectors that are null, zero, of another length than most, or hold a null or non-finite
    component take no part; nor do null ids. A row repeated with equal id and vector counts once. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    own = rows.select(rows[id_col].cast("long").alias("id"), rows[vector_col].cast("array<double>").alias("v"), is_query.alias("is_query"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    own = own.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(sound)
    lengths = own.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), F.col("n").desc()).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    own = own.filter(F.size("v") == lengths[0]["n"])
    first = Window.partitionBy("v").orderBy("id")
    # the limit on the rank is applied before the shuffle as well, so a vector of very many rows is never gathered
    few = own.select("id", "v").withColumn("r", F.dense_rank().over(first)).filter(F.col("r") <= k + 1).select("id", "v").distinct()
    entries = checkpoint(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("vid"), "v", "ids"))
    n = entries.count()
    chosen = entries.filter(F.shiftrightunsigned(F.xxhash64(F.lit("forest sample"), "vid"), 11) / F.lit(float(1 << 53)) < min(1.0, sample / n)).select("vid", "v").toPandas().sort_values("vid")
    forest = spark.sparkContext.broadcast(Forest(_matrix(chosen["v"]) if len(chosen) else np.zeros((0, lengths[0]["n"])), trees, leaf))

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                leaves = forest.value.route(_matrix(frame["v"]))
                yield pd.DataFrame({"vid": frame["vid"], "leaves": list(leaves)})

    placed = checkpoint(entries.select("vid", "v").mapInPandas(put, "vid long, leaves array<long>"))
    members = placed.select("vid", F.explode("leaves").alias("leaf"))
    sizes = np.zeros(forest.value.leaves, np.int64)  # one number for each leaf of the forest, whatever the input
    for r in members.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        sizes[r["leaf"]] = r["n"]

    search = _budget(entries, placed, forest.value, sizes, k, n, recall)

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"qid": frame["qid"], "leaves": [forest.value.search(np.asarray(v, dtype=np.float64), sizes, search) for v in frame["v"]]})

    asked = own.filter("is_query").select(F.col("id").alias("query_id"), "v").distinct().join(entries.select("v", F.col("vid").alias("qid")), "v").select("query_id", "qid")
    asked = checkpoint(asked)
    entry_of_query = asked.select(F.col("qid")).distinct().join(entries.select(F.col("vid").alias("qid"), "v"), "qid")
    visits = checkpoint(entry_of_query.mapInPandas(visit, "qid long, leaves array<long>")).select("qid", F.explode("leaves").alias("leaf"))
    asks = np.zeros(len(sizes), np.int64)
    for r in visits.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        asks[r["leaf"]] = r["n"]
    # how many blocks of rows and of queries each leaf has
    shape = F.broadcast(spark.createDataFrame(pd.DataFrame({"leaf": np.arange(len(sizes)), "rb": np.ceil(sizes / ROWS).astype(int), "qb": np.ceil(asks / QUERIES).astype(int)}).query("rb > 0 and qb > 0"), "leaf long, rb long, qb long"))

    def block(name: str) -> list:
        """A row's own block on its side, and all blocks of the other side."""
        mine, other = ("rb", "qb") if name == "vid" else ("qb", "rb")
        all_ = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        return [F.pmod(F.xxhash64(name), F.col(mine)).alias(mine[0] + "_"), all_.alias(other[0] + "_")]

    left = members.join(shape, "leaf").select("leaf", "vid", *block("vid")).join(entries.select("vid", "v"), "vid")
    right = visits.join(shape, "leaf").select("leaf", "qid", *block("qid")).join(entries.select(F.col("vid").alias("qid"), F.col("v").alias("q")), "qid")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            x, ids = _matrix(a["v"]), a["vid"].to_numpy()
            for qid, v in zip(b["qid"], b["q"], strict=True):
                d = distances(x, np.asarray(v, dtype=np.float64))
                kept = np.lexsort((ids, d))[: k + 1]
                out.append(pd.DataFrame({"qid": qid, "vid": ids[kept], "score": d[kept]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "vid": [], "score": []})

    keys = ["leaf", "r_", "q_"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "qid long, vid long, score double").distinct()
    best = Window.partitionBy("qid").orderBy("score", "vid")
    near = near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).join(entries.select("vid", "ids"), "vid")
    found = near.select("qid", "score", F.explode("ids").alias("vec_id"))
    listed = found.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("score", "vec_id"))).filter(F.col("r") <= k + 1)
    lists = listed.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("x"))  # k + 1 at most
    each = asked.join(lists, "qid").select("query_id", F.posexplode(F.slice(F.filter("x", lambda c: c["vec_id"] != F.col("query_id")), 1, k)).alias("pos", "c"))
    return each.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("c.vec_id").alias("vec_id"), F.col("c.score").alias("score"))


def nearest_embeddings(embeddings: DataFrame) -> DataFrame:
    """The 10 nearest of every row whose vec_id is divisible by 100."""
    return nearest(embeddings, embeddings["vec_id"] % 100 == 0)
