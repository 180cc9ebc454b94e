"""Removal of long strings that repeat anywhere, by a logarithmic family of suffix arrays.

Each string of `length` bytes belongs to one segment of its text, around an anchor (see `anchors`). Segments whose anchor occurs
once hold nothing that repeats. Equal segments are one entry with their number: if it is over one, all their strings
repeat. What is left, segments whose anchor occurs elsewhere in other surroundings, and one of each set of equal ones,
is dealt out by anchor and goes batch by batch through a `SuffixIndex`, which finds the strings that repeat to the byte.

An anchor with more than HOT different surroundings doesn't go to one index: its strings are counted by their digests,
which are dealt out evenly.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import segments
from .bpe_coding import parts, release
from .common import checkpoint, in_batches
from .marks import Marks
from .suffix_index import SuffixIndex

LENGTH = 400
WORDS = 51  # a passage has over 50 words
CODE = 8
SHARE = 30_000  # segments in one index
HOT = 50_000
NULL_ID = -(1 << 63)
BUFFER = 512 << 10  # bytes of texts hashed together


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(kid, tk, text): tk tells texts with one id apart. Rows with equal id and text share their fate."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("kid"), F.xxhash64(text).alias("tk"), text.cast("binary").alias("text"))


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= BUFFER or i == len(texts) - 1:
            yield start, i + 1
            start, total = i + 1, 0


def find_segments(keyed: DataFrame, length: int, code: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """(kid, tk, lo, hi, at, h, g, g2) with arrays over a text's segments; texts without a segment give no row. `code` is applied to the texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in parts(batch):
                texts = part.column("text").to_pylist()
                if code is not None:
                    texts = [code(t) for t in texts]
                for a, b in _groups(texts):
                    found = segments(texts[a:b], length)
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(found["doc"], minlength=b - a))]).astype(np.int32)
                    arrays = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[c].astype(t))) for c, t in (("lo", np.int32), ("hi", np.int32), ("at", np.int32), ("h", np.int64), ("g", np.int64), ("g2", np.int64))]
                    yield pa.RecordBatch.from_arrays([part.column("kid").slice(a, b - a), part.column("tk").slice(a, b - a), *arrays], names=["kid", "tk", "lo", "hi", "at", "h", "g", "g2"])

    long_ = keyed.filter(F.octet_length("text") >= length) if code is None else keyed
    return long_.transform(in_batches, run, "kid long, tk long, lo array<int>, hi array<int>, at array<int>, h array<long>, g array<long>, g2 array<long>")


def index_matches(cut: DataFrame, length: int, shares: int) -> DataFrame:
    """(kid, tk, start, end): the bytes that repeating strings cover, of segments (kid, tk, lo, at, h, bytes) that share anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        index, kept = SuffixIndex(length), []
        for batch in batches:
            if batch.num_rows:
                lo, at = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "at"))
                index.add(batch.column("h").to_numpy(zero_copy_only=False), batch.column("bytes").to_pylist(), at - lo)
                kept.append((*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("kid", "tk")), at))
        if kept:
            kid, tk, at = (np.concatenate(x) for x in zip(*kept, strict=True))
            entry, far, near = index.runs()
            yield pa.RecordBatch.from_arrays([pa.array(kid[entry]), pa.array(tk[entry]), pa.array((at[entry] - far).astype(np.int32)), pa.array((at[entry] - near + length).astype(np.int32))], names=["kid", "tk", "start", "end"])

    return cut.repartition(shares, "h").transform(in_batches, run, "kid long, tk long, start int, end int")


def digest_matches(cut: DataFrame, length: int) -> DataFrame:
    """The same by counting the digests of the strings themselves."""
    starts = F.sequence(F.lit(0), F.octet_length("bytes") - length)
    each = cut.select("kid", "tk", "h", (F.col("lo")).alias("lo"), "bytes", F.explode(starts).alias("k"))
    each = each.select("kid", "tk", (F.col("lo") + F.col("k")).alias("start"), F.unhex(F.md5(F.substring("bytes", F.col("k") + 1, F.lit(length)))).alias("digest"))
    twice = each.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    return each.join(twice, "digest").select("kid", "tk", "start", (F.col("start") + length).alias("end"))


def repeat_spans(keyed: DataFrame, length: int = LENGTH, hot: int = HOT, code: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """(kid, tk, spans): for each text with repeating strings, the byte ranges (start, end) that they cover, not yet merged. `code` is applied to the texts first."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in parts(batch):
                yield part.set_column(2, "text", pa.array([code(t) for t in part.column("text").to_pylist()], pa.binary()))

    # the number tells repeated rows apart; the table is checkpointed, so it stays
    found = checkpoint(find_segments(keyed, length, code).withColumn("uid", F.monotonically_increasing_id()))
    all_ = found.select("kid", "tk", "uid", F.explode(F.arrays_zip("lo", "hi", "at", "h", "g", "g2")).alias("s")).select("kid", "tk", "uid", "s.*")
    # tables of their own, so that both sides of the next joins come straight from a shuffle and a hot key's rows can be split
    several = F.min("g") != F.max("g"), F.min("g2") != F.max("g2")
    shared = checkpoint(all_.groupBy("h").agg(F.count("*").alias("n"), (several[0] | several[1]).alias("mixed")).filter("n > 1").select("h", "mixed"))
    known = all_.join(shared, "h")
    # equal segments under anchors that have others: how many, and which of them stands for all
    own = F.xxhash64("uid", "lo")
    mixed = checkpoint(known.filter("mixed").drop("mixed"))
    equal = checkpoint(mixed.groupBy("h", "g", "g2").agg(F.count("*").alias("m"), F.min(own).alias("first")))
    counted = mixed.join(equal, ["h", "g", "g2"])
    whole = known.filter("not mixed").select("kid", "tk", "lo", "hi").unionByName(counted.filter("m > 1").select("kid", "tk", "lo", "hi"))
    whole = whole.select("kid", "tk", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    kinds = checkpoint(equal.groupBy("h").agg(F.count("*").alias("kinds")))
    needed = checkpoint(counted.filter((F.col("m") == 1) | (F.col("first") == own)).join(kinds, "h").select("kid", "tk", "lo", "hi", "at", "h", "kinds"))
    shares = max(1, ceil(needed.count() / SHARE))
    # sets: rows with one id and text want the same, and are one before the shuffle
    wanted = needed.groupBy("kid", "tk").agg(F.collect_set(F.struct("lo", "hi", "at", "h", "kinds")).alias("wanted"))
    wanted = checkpoint(wanted)
    texts = Marks(wanted, "kid", "tk").on(keyed, "m").filter("m").drop("m")
    if code is not None:
        texts = texts.transform(in_batches, coded, texts.schema)
    cut = texts.join(wanted, ["kid", "tk"]).select("kid", "tk", "text", F.explode("wanted").alias("w"))
    cut = cut.select("kid", "tk", "w.lo", "w.at", "w.h", "w.kinds", F.substring("text", F.col("w.lo") + 1, F.col("w.hi") - F.col("w.lo") + length).alias("bytes"))
    matched = index_matches(cut.filter(F.col("kinds") <= hot).drop("kinds"), length, shares)
    if needed.filter(F.col("kinds") > hot).limit(1).count():
        matched = matched.unionByName(digest_matches(cut.filter(F.col("kinds") > hot), length))
    return whole.unionByName(matched).groupBy("kid", "tk").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def with_spans(keyed: DataFrame, spans: DataFrame) -> DataFrame:
    """`keyed` with the spans of each row, or null. Rows that surely have none aren't shuffled."""
    spans = checkpoint(spans)
    marked = Marks(spans, "kid", "tk").on(keyed, "_m")
    kind = spans.schema["spans"].dataType
    return marked.filter("not _m").withColumn("spans", F.lit(None).cast(kind)).unionByName(marked.filter("_m").join(spans, ["kid", "tk"], "left")).drop("_m")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal ranges, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without(text: bytes, ranges: list[tuple[int, int]], whole_letters: bool = False) -> bytes:
    """What is left of a text. `whole_letters`: a character of UTF-8 goes only if all its bytes do."""
    kept, at = [], 0
    for start, end in ranges:
        if whole_letters:
            while start < end and text[start] & 0xC0 == 0x80:
                start += 1
            while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
                end -= 1
        kept.append(text[at:start])
        at = max(at, end)
    return b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row: the maximal byte ranges that repeating strings cover, and the bytes outside them.

    A string repeats if it starts anywhere else too, in another row, even a repeated one, or in the same text. A null text counts as
    empty; an empty text, or one shorter than `length`, loses nothing. A null id counts as the least one and comes back as null.
    """
    keyed = _keyed(docs, id_col, text_col)
    spans = repeat_spans(keyed, length, hot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in parts(batch):
                texts = part.column("text").to_pylist()
                ranges = [merged(s) for s in part.column("spans").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("kid"), pa.array([len(t) for t in texts], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in r] for r in ranges], kind), pa.array([without(t, r) for t, r in zip(texts, ranges, strict=True)], pa.binary())],
                    names=["kid", "n_bytes", "spans", "kept"],
                )

    joined = with_spans(keyed, spans).select("kid", "text", "spans")
    done = joined.transform(in_batches, cut, "kid long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
    return done.select(F.when(F.col("kid") != NULL_ID, F.col("kid")).alias("doc_id"), "n_bytes", "spans", "kept")


def repeat_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) of `remove_repeats`; text: what is left, with a mark for each byte that a cut character leaves."""
    done = remove_repeats(docs, length)
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), text)


def _rewritten(docs: DataFrame, spans: DataFrame, cut: Callable[[bytes, list[tuple[int, int]]], bytes], id_col: str, text_col: str) -> DataFrame:
    """`docs` with `cut` applied to the texts that have spans. All rows stay; a null text stays null."""
    names = docs.columns
    whole = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("kid"), F.xxhash64(whole).alias("tk"))
    joined = with_spans(rows, spans).select("row", F.col(f"row.`{text_col}`").cast("string").alias("text"), "spans")
    row_type = joined.schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in parts(batch):
                texts = part.column("text").to_pylist()
                kept = [t if not s else cut(t.encode(), merged(s)).decode() for t, s in zip(texts, part.column("spans").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(kept, pa.string())], names=["row", "kept"])

    done = joined.transform(in_batches, run, T.StructType().add("row", row_type).add("kept", "string"))
    return done.select(*[F.col("kept").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names])


def drop_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """`docs` with every repeating string taken out of its text, by whole characters. All rows stay; a null text stays null."""
    spans = repeat_spans(_keyed(docs, id_col, text_col), length, hot)
    return _rewritten(docs, spans, lambda text, ranges: without(text, ranges, whole_letters=True), id_col, text_col)


def word_codes(text: bytes) -> bytes:
    """CODE bytes for each word between blanks, its hash: passages are then strings of a fixed length, whatever their words' lengths."""
    import xxhash

    words = text.split()
    known = {w: xxhash.xxh64_digest(w, 42) for w in set(words)}
    return b"".join([known[w] for w in words])


def without_words(text: bytes, ranges: list[tuple[int, int]], least: int) -> bytes:
    """What is left of a text without the words of these ranges of its codes; a range of fewer than `least` words stays."""
    places = [m.span() for m in re.finditer(rb"[^\x09-\x0d ]+", text)]
    runs = [(-(-start // CODE), end // CODE) for start, end in ranges]
    return without(text, [(places[a][0], places[b - 1][1]) for a, b in runs if b - a >= least])


def drop_passages(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """`docs` with every passage of at least `words` words that repeats anywhere taken out of its text; blanks don't count. All rows stay."""
    spans = repeat_spans(_keyed(docs, id_col, text_col), CODE * words, hot, word_codes)
    return _rewritten(docs, spans, lambda text, ranges: without_words(text, ranges, words), id_col, text_col)
