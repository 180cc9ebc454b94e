"""Best-fit packing of documents into training sequences under several capacities.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece lengths). Pieces are placed
in decreasing length. Of the open sequences that can take a piece under every capacity, the one is chosen with the least
weighted norm of what would be left ("norm"), or with the greatest weighted dot product of the piece's needs and what the
sequence already holds ("dot"); with none, a new sequence opens.

Each task packs its share of the pieces, SHARE at most. Sequences that stay open after that are dissolved, and their pieces are
packed again, in fewer shares, until one share is left or too few have found a place (as where all pieces are just over half a
sequence). So all rounds together pack at most four times the pieces, and no task more than its share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_coding import codec, parts
from .common import broadcast_file, checkpoint, id_text, in_batches, vocabulary_path

SHARE = 20_000  # pieces that one task packs
CLOSED = 0.99  # of the tokens: a sequence filled so far is not packed again
LESS = 0.75  # another round must have at most this share of the pieces to pack, or what is open stays as it is
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokens: int = 4096, end_id: int = 1, tokenizer_path: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids with `end_id` behind, cut into pieces of `tokens`: (doc_id, piece, start, length, ids_crc32[, ids]).

    A null or empty text has `end_id` alone. Repeated rows and repeated or null ids each give their own pieces.
    """
    vocabulary, key = broadcast_file(docs.sparkSession, vocabulary_path("word_bpe_49k.json", tokenizer_path))
    tail = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(lambda: vocabulary.value, key)
        for batch in batches:
            for part in parts(batch):
                rows: list[tuple] = []
                for doc, packed in zip(part.column("doc_id").to_pylist(), own.encode(part.column("text").to_pylist()), strict=True):
                    packed += tail
                    for k, at in enumerate(range(0, len(packed), 4 * tokens)):
                        ids = packed[at : at + 4 * tokens]
                        rows.append((doc, k, at // 4, len(ids) // 4, zlib.crc32(ids), *([ids] if with_ids else [])))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return id_text(docs, id_col, text_col).transform(in_batches, cut, PIECES + (", ids binary" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float], score: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the tokens in each bin. `lengths` is in decreasing order."""
    cap, w = np.array(capacity, dtype=float), np.array(weights, dtype=float)
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    left = np.empty((3, n))  # what is left of each capacity in each open bin
    names = np.empty(n, np.int64)  # which bin that is
    used = np.zeros(n, np.int64)
    count = opened = 0
    least = lengths[-1] if n else 0
    for i, size in enumerate(lengths.tolist()):
        need = (size, 1.0, float(size) * size)
        where = -1
        if count:
            fits = np.flatnonzero((left[0, :count] >= need[0]) & (left[1, :count] >= need[1]) & (left[2, :count] >= need[2]))
            if fits.size:
                if score == "norm":
                    value = sum(w[d] * ((left[d, fits] - need[d]) / cap[d]) ** 2 for d in range(3))
                else:
                    value = -sum(w[d] * (need[d] / cap[d]) * (1 - left[d, fits] / cap[d]) for d in range(3))
                where = int(fits[np.argmin(value)])
        if where < 0:
            where = count
            left[:, where], names[where] = cap, opened
            count, opened = count + 1, opened + 1
        bins[i], offsets[i] = names[where], used[names[where]]
        used[names[where]] += size
        for d in range(3):
            left[d, where] -= need[d]
        if left[0, where] < least or left[1, where] < 1 or left[2, where] < float(least) ** 2:  # nothing more fits
            count -= 1
            left[:, where], names[where] = left[:, count], names[count]
    return bins, offsets, used[:opened]


def pack(pieces: DataFrame, tokens: int = 4096, documents: int | None = None, attention: float | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), score: str = "norm") -> DataFrame:
    """`pieces` (doc_id, piece, length and any others) with sequence_id and offset.

    By default up to `tokens` documents go into a sequence and up to `tokens` squared attention cost, which the tokens alone
    already guarantee. A piece beyond a capacity by itself is an error.
    """
    capacity = (float(tokens), float(documents or tokens), float(attention or tokens * tokens))
    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(False).alias("_open")).schema

    def share(round_: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            got = list(frames)
            if not got:
                return
            df = pd.concat(got, ignore_index=True)
            df = df.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
            if len(df) and (df["length"].iloc[0] > min(capacity[0], capacity[2] ** 0.5)):
                raise ValueError(f"a piece of {df['length'].iloc[0]} tokens is over a capacity of {capacity}")
            bins, offsets, used = best_fit(df["length"].to_numpy(), capacity, weights, score)
            df["sequence_id"] = (round_ << 56) + (TaskContext.get().partitionId() << 28) + bins
            df["offset"] = offsets
            df["_open"] = used[bins] < CLOSED * tokens
            yield df

        return run

    rest = checkpoint(pieces)
    left = rest.count()
    done, round_ = None, 0
    while True:
        shares = max(1, ceil(left / SHARE))
        # by turns, as a repeated or null id may hold any part of the rows; the input is checkpointed, so a task that runs again gets the same rows
        packed = checkpoint(rest.repartition(shares).mapInPandas(share(round_), schema))
        open_ = packed.filter("_open").count() if shares > 1 else 0
        if open_ > LESS * left:
            open_ = 0
        closed = packed if not open_ else packed.filter(~F.col("_open"))
        done = closed if done is None else done.unionByName(closed)
        if not open_:
            return done.drop("_open")
        rest, left, round_ = packed.filter("_open").drop("sequence_id", "offset", "_open"), open_, round_ + 1


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the training sequences of a packing whose pieces were cut `with_ids`."""
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("offset", "ids"))), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def packed_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all documents in sequences of at most 4096 tokens."""
    return pack(cut_pieces(docs, tokenizer_path=tokenizer_path))
