"""Token counts, byte-pair coding and packing against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from deltaweave.llm.bpe import Codec
from deltaweave.llm.bpe_coding import coding_digests
from deltaweave.llm.packing import best_fit, cut_pieces, pack, packed_documents, sequences
from deltaweave.llm.token_counts import Pieces, splice_encode, token_counts

SCHEMA = "doc_id long, text string, n_tokens string, n_bytes string"  # with names that clash with results
TEXTS = ["", " ", "  two  spaces \n\n and lines ", "It's <|endoftext|> we'LL <s> ok", "ΑΣ ΟΔΟΣ é \x1c x", "a" * 700, "ab " * 3000, "漢字 😀 é" * 50, None, "same", "same"]


def table(spark, texts=TEXTS):
    return spark.createDataFrame([(i if i != 3 else None, t, "x", None) for i, t in enumerate(texts)], SCHEMA)


def library(name):
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("chunk, overlap", [(1, 1), (3, 2), (20, 1), (64, 16)])
def test_splices_are_exact(chunk, overlap):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        pieces = Pieces(f.read())
    rng, widened = random.Random(chunk), []
    for text in [t or "" for t in TEXTS] + ["".join(rng.choice("ab é▁ \n漢😀the ") for _ in range(rng.randrange(300))) for _ in range(30)]:
        text = text[:600]
        assert splice_encode(pieces, text, chunk, overlap, widened.append).tolist() == pieces.model.encode(text)
    assert widened or overlap > 1


def test_token_counts(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = token_counts(table(spark), chunk_chars=500, limit=100).collect()
    wanted = [(i if i != 3 else None, len((t or "").encode()), len(model.encode(t or ""))) for i, t in enumerate(TEXTS)]
    assert sorted(map(str, [(r[0], r[1], r[2]) for r in got])) == sorted(map(str, wanted))
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert token_counts(table(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_codec_equals_the_library(name):
    with open(public_tokenizers.path(name)) as f:
        own = Codec(f.read(), words=50)
    ref, rng = library(name), random.Random(1)
    bits = ["a", "the", " ", "  ", "\n", "\t", "'s", "É", "Σ", "1", ".", "😀", "<|endoftext|>", "<|", "\x1d", "́", "aaaaaaaaaa", "xyz" * 40]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(300)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        wanted = ref.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == wanted, text
        if name[0] == "b":
            assert own.decode(ids) == ref.decode(wanted, skip_special_tokens=False) == text


def test_coding_digests(spark):
    ref, rows = library("byte_bpe_50k.json"), coding_digests(table(spark)).collect()
    wanted = []
    for i, t in enumerate(TEXTS):
        ids = ref.encode(t or "", add_special_tokens=False).ids
        wanted.append((i if i != 3 else None, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, wanted))


def test_packing_holds_every_piece_once(spark):
    rng = random.Random(4)
    texts = [*TEXTS, *[" ".join(rng.choice(["cat", "runs", "blue"]) for _ in range(rng.randrange(9000))) for _ in range(30)]]
    ref = library("word_bpe_49k.json")
    rows = packed_documents(table(spark, texts)).collect()
    wanted = {}
    for i, t in enumerate(texts):
        ids = [*ref.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            wanted[(i if i != 3 else None, k)] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == wanted and len(rows) == len(wanted)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(v[1] for v in wanted.values()) // 4096) + 1


def test_every_capacity_binds():
    sizes = np.array(sorted([5] * 40 + [30] * 10, reverse=True))
    for score in ("norm", "dot"):
        bins, offsets, used = best_fit(sizes, (100.0, 3.0, 2000.0), (1, 1, 1), score)
        for b in range(len(used)):
            own = sizes[bins == b]
            assert own.sum() == used[b] <= 100 and len(own) <= 3 and (own.astype(float) ** 2).sum() <= 2000


def test_rest_is_packed_again_and_joined(spark, monkeypatch):
    import deltaweave.llm.packing as P

    monkeypatch.setattr(P, "SHARE", 10)
    docs = spark.createDataFrame([(i, "word " * (i * 7 % 50)) for i in range(60)], "doc_id long, text string")
    packed = pack(cut_pieces(docs, tokens=64, with_ids=True), tokens=64)
    lengths = {r["sequence_id"]: r["n"] for r in packed.groupBy("sequence_id").agg({"length": "sum"}).toDF("sequence_id", "n").collect()}
    assert max(lengths.values()) <= 64 and len(lengths) <= sum(lengths.values()) // 64 + 3
    assert {r["sequence_id"]: len(r["ids"]) // 4 for r in sequences(packed).collect()} == lengths
    with pytest.raises(Exception, match="over a capacity"):
        pack(cut_pieces(docs, tokens=64), tokens=32).count()
    assert packed_documents(docs.limit(0)).count() == 0


def test_pieces_over_half_end_after_one_round(spark, monkeypatch):
    import deltaweave.llm.packing as P

    monkeypatch.setattr(P, "SHARE", 20)
    seen = []
    monkeypatch.setattr(P, "checkpoint", lambda df, own=P.checkpoint: seen.append(1) or own(df))
    rows = [(None if i % 3 else i, 0, 0, 40, i) for i in range(200)]
    packed = pack(spark.createDataFrame(rows, P.PIECES), tokens=64).collect()
    assert len(packed) == 200 == len({r["sequence_id"] for r in packed}) and len(seen) == 2


def test_texts_as_a_column_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, ref, rng = Codec(open(path).read()), library("word_bpe_49k.json"), random.Random(7)
    letters = ["a", "B", " ", " ", "\x1c", "\x85", "\u0301", "é", "Σ", "İ", "ß", "<|endoftext|>", "<|", "'S", "'re", "1", "२", "\n", "\t", "中", "!", "\u2009", "\u3000", "\x00", "\x0b", "ﬁ", "…", "ж", "한", "\ufeff"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(5000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [ref.encode(t, add_special_tokens=False).ids for t in texts]
