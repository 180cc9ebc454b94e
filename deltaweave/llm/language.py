"""Language identification: multinomial logistic regression on TF-IDF of hashed character n-grams.

The document frequencies are counted over every document that may be learned from. The weights are fitted, with
follow-the-regularised-leader and an elastic net, on a sample of about PER_LANGUAGE documents of each language (a document
is in the sample if a hash of its id is below the language's rate), four fifths of it; on the last fifth one temperature
is fitted that calibrates the scores.

Features of a text are the n-grams of its lower-cased code points, hashed to FEATURES. Their frequencies add to one, so a text's
logits are a mean over its n-grams, and a text of any length is scored in one pass without a table of its counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_coding import parts, release
from .common import checkpoint, in_batches
from .ftrl import Ftrl, softmax

FEATURES = 1 << 16
ORDERS = (1, 2, 3)
PER_LANGUAGE = 600
EPOCHS = 3
SCALE = 40.0
UNKNOWN = "und"
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))  # odd numbers that spread code points
SLICE = 128  # texts hashed together


def ngrams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: the features of all texts in a row, and where each text's begin and end."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    out = []
    for order in ORDERS:
        n = max(0, len(points) - order + 1)
        mixed = np.full(n, np.uint32(order * 0x27D4EB2F & 0xFFFFFFFF))
        for k in range(order):
            mixed = (mixed ^ points[k : k + n]) * _FACTORS[k]
            mixed ^= mixed >> np.uint32(15)
        mixed *= _FACTORS[0]
        out.append(((mixed >> np.uint32(16)).astype(np.int32), starts, np.maximum(starts, ends - order + 1)))
    return out


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's features and how often it has each."""
    return np.unique(np.concatenate([x for x, _, _ in ngrams([text])]), return_counts=True)


def tree_sum(df: DataFrame, column: str, fan: int = 16) -> np.ndarray | None:
    """The sum of arrays (packed 64-bit integers) over all rows, added up by tasks until at most `fan` are left."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total = np.frombuffer(x, np.int64) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=[column])

    df = df.select(column)
    n = df.rdd.getNumPartitions()
    while n > fan:
        n = ceil(n / fan)
        df = df.repartition(n).transform(in_batches, add, f"{column} binary")
    rows = [np.frombuffer(r[0], np.int64) for r in df.collect()]
    return sum(rows[1:], rows[0]) if rows else None


class Model:
    """Languages, inverse document frequencies, weights and temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.temperature, self.bias = languages, temperature, bias
        self.table = (weights * idf[:, None] * SCALE).astype(np.float32)

    def logits(self, texts: list[str]) -> np.ndarray:
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for features, starts, ends in ngrams(texts):
            some = np.flatnonzero(ends > starts)
            if some.size:
                values = np.concatenate([self.table[features], np.zeros((1, total.shape[1]), np.float32)])
                marks = np.stack([starts[some], ends[some]], axis=1).ravel()
                total[some] += np.add.reduceat(values, marks, axis=0, dtype=np.float64)[::2]
                count += ends - starts
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known and self.languages:
            shares = softmax(self.logits([texts[i].lower() for i in known]) / self.temperature)
            for i, best, share in zip(known, shares.argmax(axis=1), shares.max(axis=1), strict=True):
                names[i], scores[i] = self.languages[best], float(min(1.0, share))
        return names, scores


def train(languages: list[str], idf: np.ndarray, rows: list[tuple[int, np.ndarray, np.ndarray]], alpha: float = 0.5, l1: float = 0.02, l2: float = 0.1) -> Model:
    """`rows`: (language, features, counts), in an order that does not depend on the cluster."""
    fit = [r for i, r in enumerate(rows) if i % 5]
    held = rows[::5] if len(rows) >= 50 else rows
    fit = fit if len(rows) >= 50 else rows
    ftrl, bias = Ftrl(FEATURES, len(languages), alpha, l1, l2), Ftrl(1, len(languages), 0.1, 0.0, 1.0)
    one = np.array([0])

    def vector(features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts / counts.sum() * idf[features] * SCALE

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(fit)):
            label, features, counts = fit[i]
            x, w, b = vector(features, counts), ftrl.weights(features), bias.weights()
            error = softmax(x @ w + b[0])
            error[label] -= 1
            ftrl.update(features, w, x[:, None] * error)
            bias.update(one, b, error[None, :])
    weights, offset = ftrl.weights(), bias.weights()[0]
    logits = np.array([vector(f, c) @ weights[f] + offset for _, f, c in held]).reshape(len(held), len(languages))
    labels = np.array([r[0] for r in held], dtype=int)

    def loss(t: float) -> float:
        return float(-np.log(softmax(logits / exp(t))[np.arange(len(labels)), labels] + 1e-12).sum())

    low, high = log(0.05), log(20.0)
    for _ in range(60 if len(held) else 0):  # golden section
        a, b = high - (high - low) * 0.618, low + (high - low) * 0.618
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return Model(languages, idf, weights, offset, exp((low + high) / 2) if len(held) else 1.0)


def fit(learn: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from `learn` (doc_id, text, lang); rows with a null in text or lang say nothing."""
    learn = learn.filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))]), F.col("lang")) if languages else F.lit(0.0)
    sampled = F.shiftrightunsigned(F.xxhash64(F.lit("language sample"), "doc_id"), 11) / F.lit(float(1 << 53)) < share
    index = {k: i for i, k in enumerate(languages)}

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        frequency, flags = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, bool)
        schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
        seen = 0
        for batch in batches:
            for part in (p for x in parts(batch) for p in (x.slice(at, SLICE) for at in range(0, x.num_rows, SLICE))):
                texts = [t.lower() for t in part.column("text").to_pylist()]
                seen += len(texts)
                grams = ngrams(texts)
                for i in range(len(texts)):
                    flags[:] = False
                    for features, starts, ends in grams:
                        flags[features[starts[i] : ends[i]]] = True
                    frequency += flags
                out = []
                for i, (chosen, lang, doc) in enumerate(zip(*(part.column(c).to_pylist() for c in ("sampled", "lang", "doc_id")), strict=True)):
                    if chosen:
                        features, counts = counted(texts[i])
                        out.append((index[lang], doc, features.astype(np.int32).tobytes(), counts.astype(np.int32).tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((-1, seen, frequency.tobytes(), None), schema, strict=True)], schema=schema)

    made = checkpoint(learn.select("doc_id", "text", "lang", sampled.alias("sampled")).transform(in_batches, collect, "kind int, id long, a binary, b binary"))
    frequency = tree_sum(made.filter("kind = -1"), "a")
    n = sum(sizes.values())
    idf = np.log((1 + n) / (1 + (np.zeros(FEATURES) if frequency is None else frequency))) + 1
    rows = [(r["kind"], np.frombuffer(r["a"], np.int32), np.frombuffer(r["b"], np.int32)) for r in sorted(made.filter("kind >= 0").collect(), key=lambda r: (str(r["id"]), bytes(r["a"]), r["kind"]))]
    rows = [r for r in rows if len(r[1])]
    order = np.random.default_rng(7).permutation(len(rows))
    return train(languages, idf, [rows[i] for i in order])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row; `und` with score 0 for a text that is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own = shared.value
        for batch in batches:
            for part in parts(batch):
                for at in range(0, part.num_rows, SLICE):
                    piece = part.slice(at, SLICE)
                    names, scores = own.predict(piece.column("text").to_pylist())
                    yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).transform(in_batches, run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4. A null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def held_out_language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the documents that are not held out.

    Each row keeps its own, also rows that repeat or whose id is null (never held out, and not learned from). A text that is null or
    has no letter is UNKNOWN. Of languages with equal scores the first by name is given. An empty table gives an empty result.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    model = fit(own.filter(~held_out() & F.col("doc_id").isNotNull()), per_language)
    return identify(own, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` with the language and its score behind its own columns, under `names`; own columns of these names are replaced.

    Rows that repeat, and those with null or repeated ids, each keep their row. A text that is null or has no letter is UNKNOWN. An empty
    table gives an empty one.
    """
    shared, rows = docs.sparkSession.sparkContext.broadcast(model), docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own = shared.value
        for batch in batches:
            for part in parts(batch, text_col):
                for at in range(0, part.num_rows, SLICE):
                    piece = part.slice(at, SLICE)
                    found, scores = own.predict(piece.column(text_col).to_pylist())
                    yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*piece.schema.names, *names])

    schema = T.StructType([*rows.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return rows.transform(in_batches, run, schema)
