"""Token counts of whole texts by overlap resynchronisation.

A text of up to `chunk_chars` characters is encoded at once. A longer one is encoded in chunks that overlap. Each token of
a chunk has its place in the normalised text, so a token that two neighbouring chunks both have (same start, same end) is
a common boundary, and the two encodings are spliced behind it.

Why such a splice is exact: a sequence of pieces is the encoding of its text if and only if every two neighbours are the
encoding of their own joined text, because merges on either side of a boundary that is never crossed do not depend on each
other. Up to the shared token all neighbours stand next to each other in the first chunk's encoding, and from it on in
the second's. Where two chunks share no token, the overlap is doubled until they do, at most until the later chunk
starts with the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import broadcast_file, id_text, in_batches, vocabulary_path

SPACE = "▁"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_loaded: dict = {}


class Pieces:
    """A sentencepiece model and the bytes that each of its pieces covers in the normalised text."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.model.get_piece_size()
        self.width = np.array([1 if self.model.is_byte(i) else len(self.model.id_to_piece(i).encode()) for i in range(n)], dtype=np.int64)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), dtype=np.int64)

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _chunk(pieces: Pieces, norm: str, start: int, end: int, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, starts and ends (bytes of the normalised text) of norm[start:end]; `at`: the byte where it starts."""
    lead = len(SPACE.encode())  # the library puts a space mark before what it is given
    ids = pieces.encode(norm[1:end] if start == 0 else norm[start:end])
    ends = np.cumsum(pieces.width[ids]) + (0 if start == 0 else at - lead)
    return ids, ends - pieces.width[ids], ends


def splice_encode(pieces: Pieces, text: str, chunk_chars: int, overlap_chars: int, widened: Callable[[int], None] | None = None) -> np.ndarray:
    """Ids of the whole text. `widened` is told each overlap that had to be tried beyond the first."""
    if len(text) <= chunk_chars:
        return pieces.encode(text)
    norm = SPACE + text.replace(" ", SPACE)
    end, at_end = chunk_chars, len(norm[:chunk_chars].encode())
    ids, starts, ends = _chunk(pieces, norm, 0, end, 0)
    done: list[np.ndarray] = []
    step = chunk_chars
    while end < len(norm):
        overlap, later = overlap_chars, min(len(norm), end + step)
        while True:
            begin = max(0, end - overlap)
            at = at_end - len(norm[begin:end].encode())
            ids2, starts2, ends2 = _chunk(pieces, norm, begin, later, at)
            if begin == 0:  # the later chunk holds everything before it
                done, ids, starts, ends = [], ids2, starts2, ends2
                step = later  # next, as much again: such texts cost n log n, not n squared
                break
            near = np.flatnonzero((starts >= at) & (ends > starts))
            same = np.searchsorted(starts2, starts[near])
            same = np.minimum(same, len(starts2) - 1)
            hit = np.flatnonzero((starts2[same] == starts[near]) & (ends2[same] == ends[near]) & (ids2[same] == ids[near]))
            if hit.size:
                i, j = near[hit[0]], same[hit[0]]
                done.append(ids[: i + 1])
                ids, starts, ends = ids2[j + 1 :], starts2[j + 1 :], ends2[j + 1 :]
                break
            overlap *= 2
            if widened:
                widened(overlap)
        at_end += len(norm[end:later].encode())
        end = later
    return np.concatenate([*done, ids])


def token_counts(docs: DataFrame, model_path: str | None = None, limit: int = 4096, chunk_chars: int = 65536, overlap_chars: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of `docs`.

    A null text counts as empty: no bytes, no tokens. Repeated rows and repeated or null ids each keep their own row. Other
    columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    model, key = broadcast_file(spark, vocabulary_path("piece_bpe_32k.model", model_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Pieces(model.value)
        pieces = _loaded[key]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                found = dict.fromkeys(range(len(texts)), 0)
                short = [i for i, t in enumerate(texts) if len(t) <= chunk_chars]
                for i, ids in zip(short, pieces.encode_many([texts[i] for i in short]), strict=True):
                    found[i] = len(ids)
                for i in set(found) - set(short):
                    found[i] = len(splice_encode(pieces, texts[i], chunk_chars, overlap_chars))
                n = pa.array([found[i] for i in range(len(texts))], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pc.cast(pc.binary_length(part.column("text")), pa.int64()), n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
                )

    return id_text(docs, id_col, text_col).transform(in_batches, count, SCHEMA)
