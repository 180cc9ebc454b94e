"""Encoding whole texts with a byte-pair vocabulary and decoding the ids again, on Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec
from .common import broadcast_file, id_text, in_batches, vocabulary_path

#: A part of a batch holds about so many bytes of text: enough words for the merges in step, little memory.
PART_BYTES = 4 << 20
_loaded: dict[str, Codec] = {}


def codec(data: Callable[[], bytes], key: str, words: int = 250_000) -> Codec:
    """This worker's codec for a vocabulary; what it remembers stays for the worker's next tasks."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Codec(data().decode(), words)
    return _loaded[key]


def release() -> None:
    """Let go of what this worker's codec remembers: a worker may turn to another operator while it still holds it."""
    _loaded.clear()


def parts(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of about PART_BYTES, by whole rows."""
    start, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        total += n
        if total >= PART_BYTES:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def bpe_round_trip(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) for each row: ids packed as little-endian unsigned 32-bit integers, and the text they decode to.

    No special token is added; special strings in a text become their tokens and decode to themselves. A null text counts as
    empty (no ids, an empty text). Rows with repeated or null ids each keep their own row; other columns are not read.
    """
    vocabulary, key = broadcast_file(docs.sparkSession, vocabulary_path("byte_bpe_50k.json", tokenizer_path))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(lambda: vocabulary.value, key)
        for batch in batches:
            for part in parts(batch):
                packed = own.encode(part.column("text").to_pylist())
                decoded = pa.array([own.decode(x) for x in packed], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed, pa.binary()), decoded], names=["doc_id", "ids", "decoded"])

    return id_text(docs, id_col, text_col).transform(in_batches, code, "doc_id long, ids binary, decoded string")


def coding_digests(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of `bpe_round_trip`."""
    coded = bpe_round_trip(docs, tokenizer_path)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
