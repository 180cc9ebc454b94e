"""Toxicity severity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(theta_k - s) with one score s = w . x for all thresholds theta_0 < theta_1 < ..., so the grades share
their weights; the expected severity is the sum of P(grade > k). x says which known words a whole text has, each by the root of its
inverse document frequency among the training texts. The weights are
fitted, with follow-the-regularised-leader and an elastic net, on about SAMPLE labelled documents, half of them toxic where there
are as many (a document is in the sample if a hash of its id is below the rate of its label).

The labels say only whether a text is toxic. The grades of toxic training texts are by dose: how many different words they
have that are far more frequent among toxic texts, cut into LEVELS levels at the sample's quantiles. Grade 0 is not toxic.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import fsum, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_coding import parts, release
from .common import checkpoint, in_batches
from .ftrl import Ftrl

SAMPLE = 3000
LEVELS = 3
LEAST_DOCS = 8  # a word is known if so many of the sample's documents have it
EPOCHS = 6
CUT = 0.2  # a text is called toxic from this chance on: missing one costs more than a second look
STEMS = (3, 5, 7)
EDGES = ".,;:!?\"'()[]{}<>|*$%&#@+=/~^-_…«»“”"


def words_of(text: str) -> set[str]:
    """The features of a text: its different words (between blanks, lower-cased, without marks at their edges), and the
    beginnings of the longer ones, for languages that build on a stem."""
    found = {w.strip(EDGES) for w in set(text.lower().split())}
    found.discard("")
    for n in STEMS:
        found |= {w[:n] + "-" for w in found if len(w) > n and w[-1] != "-"}
    return found


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Word weights and ordered thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def predict(self, text: str | None) -> tuple[float, int, float]:
        """Expected severity, most likely grade, and the chance of any toxicity."""
        words = words_of(text or "")
        if not words:
            return 0.0, 0, 0.0
        known = words & self.weights.keys()
        over = sigmoid(fsum(self.weights[w] for w in known) - self.thresholds)
        shares = -np.diff(np.concatenate([[1.0], over, [0.0]]))
        return float(over.sum()), int(shares.argmax()), float(over[0])


def dose_words(rows: list[tuple[int, set[str]]]) -> set[str]:
    """Words that are at least eight times as frequent among toxic texts, and in at least one in fifty of them."""
    toxic, clean = [w for y, w in rows if y], [w for y, w in rows if not y]
    hot, cold = Counter(w for ws in toxic for w in ws), Counter(w for ws in clean for w in ws)
    return {w for w, n in hot.items() if n >= max(LEAST_DOCS, len(toxic) / 50) and n / len(toxic) >= 8 * (cold[w] + 1) / (len(clean) + 1)}


def train(rows: list[tuple[int, set[str]]], clean_share: float = 1.0, alpha: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> Model:
    """`rows`: (toxic, words), in an order that does not depend on the cluster. `clean_share`: how much more densely toxic
    documents were sampled than others; the thresholds are moved by its logarithm. `l1`: for each row."""
    if not any(y for y, _ in rows):
        return Model({}, np.arange(LEVELS) + 40.0)
    dose = dose_words(rows)
    doses = [len(w & dose) for y, w in rows if y]
    cuts = np.quantile(doses, np.arange(1, LEVELS) / LEVELS) if doses else np.zeros(LEVELS - 1)
    grades = [1 + int((len(w & dose) > cuts).sum()) if y else 0 for y, w in rows]
    counts = Counter(w for _, ws in rows for w in ws)
    index = {w: i for i, w in enumerate(sorted(w for w, n in counts.items() if n >= LEAST_DOCS))}
    idf = np.sqrt([log(len(rows) / counts[w]) for w in index])
    vectors = [np.array(sorted(index[w] for w in ws if w in index), dtype=np.int64) for _, ws in rows]
    ftrl = Ftrl(len(index), 1, alpha, l1 * len(rows), l2)
    theta, seen = np.arange(LEVELS, dtype=float) + 1.0, np.full(LEVELS, 1.0)
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            features, grade = vectors[i], grades[i]
            w = ftrl.weights(features)
            x = idf[features]
            s = float(x @ w[:, 0])
            high = sigmoid(theta[grade] - s) if grade < LEVELS else 1.0
            low = sigmoid(theta[grade - 1] - s) if grade else 0.0
            share = max(high - low, 1e-9)
            slope_high, slope_low = high * (1 - high), low * (1 - low)
            gradient = np.clip((slope_high - slope_low) / share, -10, 10)
            if len(features):
                ftrl.update(features, w, (x * gradient)[:, None])
            for k, g in ((grade, -slope_high / share), (grade - 1, slope_low / share)):
                if 0 <= k < LEVELS:
                    g = float(np.clip(g, -10, 10))
                    seen[k] += g * g
                    theta[k] -= 0.3 * g / np.sqrt(seen[k])
            for k in range(1, LEVELS):  # the thresholds stay in order
                theta[k] = max(theta[k], theta[k - 1] + 0.05)
    final = ftrl.weights()[:, 0] * idf if index else np.zeros(0)
    return Model({w: float(final[i]) for w, i in index.items() if final[i]}, theta + log(clean_share))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from `docs` (doc_id, text) and `labels` (doc_id, toxic). Nulls say nothing; a document with several labels is toxic if any says so."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), (labels["toxic"] > 0).cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    dense, thin = (min(1.0, sample / 2 / max(1, sizes.get(k, 0))) for k in (1, 0))
    rate = F.when(F.col("toxic") == 1, dense).otherwise(thin)
    chosen = known.filter(F.shiftrightunsigned(F.xxhash64(F.lit("toxicity sample"), "doc_id"), 11) / F.lit(float(1 << 53)) < rate)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).filter("text is not null")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in parts(batch):
                words = [sorted(words_of(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "toxic", "words"])

    # about `sample` rows of ids, whatever the input
    made = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").transform(in_batches, collect, "doc_id long, toxic int, words array<string>")
    made = checkpoint(made)
    # words of fewer documents are never known: they needn't come to the driver
    each = made.select("doc_id", F.explode("words").alias("word")).distinct()
    common = each.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_DOCS)
    held = each.join(common, "word").groupBy("doc_id").agg(F.sort_array(F.collect_list("word")).alias("words"))
    rows = made.select("doc_id", "toxic").distinct().join(held, "doc_id", "left").collect()
    rows = sorted((r["doc_id"], r["toxic"], r["words"] or []) for r in rows)
    return train([(y, set(w)) for _, y, w in rows], dense / thin)


def severity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) for each row.

    severity: the expected grade; toxic: whether p_toxic is at least CUT. A null text counts as empty, and a text
    without words has severity 0. Repeated rows and repeated or null ids each keep their own row; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of the sample, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own = shared.value
        for batch in batches:
            for part in parts(batch):
                found = [own.predict(t) for t in part.column("text").to_pylist()]
                columns = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.float64(), pa.int32(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, pa.array([x[2] >= CUT for x in found], pa.bool_())], names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).transform(in_batches, run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def labelled_severity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """`severity` of all documents by a model of the labelled ones. Without a toxic label no text is toxic. An empty table gives an empty result; rows that repeat each keep their row."""
    return severity(docs, fit(docs, labels, sample))
