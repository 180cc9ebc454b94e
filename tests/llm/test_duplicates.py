"""SimHash groups, near copies, repeated strings and components against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from deltaweave.llm.anchors import segments
from deltaweave.llm.common import checkpoint
from deltaweave.llm.components import components
from deltaweave.llm.near_copies import one_of_each, shingle_set
from deltaweave.llm.repeats import drop_passages, drop_repeats, merged, remove_repeats, repeat_digests, without
from deltaweave.llm.simhash import fingerprint_components, fingerprint_many, link_fingerprints, masks, near_duplicates
from deltaweave.llm.suffix_index import SuffixIndex


def closure(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def size_bits(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_checkpoints_keep_size_estimates_small(spark):
    """Each join multiplies the estimates of its sides; over a chain of checkpoints they must not grow on."""
    start = spark.range(20).selectExpr("id as a", "id % 7 as b")
    made = checkpoint(start)
    assert size_bits(made) == size_bits(start)
    for _ in range(6):
        made = checkpoint(made.join(made.select("a", F.col("b").alias("c")), "a").select("a", F.col("c").alias("b")))
        assert size_bits(made) < 65
    assert sorted(map(tuple, made.collect())) == [(i, i % 7) for i in range(20)]
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(30)]
    assert size_bits(components(spark.createDataFrame(links, "a long, b long"))) < 65


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 150 + i) for i in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)] + [(7, 7)]
    wanted = {n: r for n, r in closure({x for l in links for x in l}, links).items() if n != r}
    got = components(spark.createDataFrame([*links, (None, 5)], "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == wanted
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_the_radius(radius):
    rng = random.Random(radius)
    for _ in range(500):
        flip = sum(1 << i for i in rng.sample(range(64), radius))
        assert any(not m & flip & (1 << 64) - 1 for m in masks(radius))


@pytest.mark.parametrize("bucket, direct", [(512, False), (1, False), (512, True)])
def test_links_reach_every_pair(spark, bucket, direct):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(12)}
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    df = spark.createDataFrame([(0, v) for v in signed], "f int, fp long")
    got = [(r["a"], r["b"]) for r in link_fingerprints(df, 2, bucket, direct).collect()]
    assert closure(signed, got) == closure(signed, near)
    if direct:
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in got)


def test_fingerprint_components(spark):
    texts = ["", None, " \t", "One two", "one TWO", "a b c d e f g", "A b c d e f g", "É b c", "é b c", "x " * 500, "a b c d e f g"]
    docs = spark.createDataFrame([(i + 5, t, "f", "c") for i, t in enumerate(texts)] + [(None, "solo words here", "f", "c")], "doc_id long, text string, fingerprint string, component_id string")

    def fp(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i + 5: fp(t) for i, t in enumerate(texts)}
    groups = closure(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    rows = {r["doc_id"]: r for r in fingerprint_components(docs).collect()}
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in rows.items() if k is not None} == {k: (f"{v:016x}", groups[k]) for k, v in prints.items()}
    assert rows[None]["component_id"] is None and near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each_near_copy(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    base = [[rng.choice(words) for _ in range(400)] for _ in range(6)]
    near = [*base[0][:200], "edit", *base[0][201:]]
    far = [*base[1][:200], *[rng.choice(words) for _ in range(200)]]
    texts = [" ".join(x) for x in [*base, near, far, base[2]]] + [None, "  ", ""]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(2, texts[2], 2)], "doc_id long, text string, kid int")
    got = one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 1, 2, 3, 4, 5, 7, 9]
    assert one_of_each(docs.limit(0)).count() == 0


def test_one_of_each_finds_pairs_of_every_kind_of_edit(spark):
    """Just over 0.8: words exchanged here and there, a new block behind, a block replaced; all of different words."""
    texts = []
    for k in range(12):
        base = [f"d{k}w{i}" for i in range(400)]
        texts += [base, [f"e{k}" if i in (60, 140, 220, 300) else w for i, w in enumerate(base)], base + [f"n{k}x{i}" for i in range(90)], base[:360] + [f"r{k}x{i}" for i in range(40)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in one_of_each(docs).collect()) == list(range(0, 48, 4))


def test_one_of_each_is_the_closure_of_all_pairs(spark):
    """Groups in which the least text is like none of the others, and chains of edits."""
    rng = random.Random(12)
    texts = []
    for k in range(10):
        base = [f"d{k}w{i}" for i in range(200)]
        blocks = [base[i : i + 10] for i in range(0, 200, 10)]
        texts.append([w for b in rng.sample(blocks, 20) for w in b])  # the same words in another order
        for _ in range(8):
            base = list(base)
            at = rng.randrange(200)
            base[at : at + rng.randrange(1, 18)] = [f"e{k}x{rng.randrange(9)}"]
            texts.append(base)
    rng.shuffle(texts)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    n = range(len(texts))
    groups = closure(n, [(i, j) for i in n for j in n if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert 10 < len(set(groups.values())) < 80
    assert sorted(r["doc_id"] for r in one_of_each(docs).collect()) == sorted(set(groups.values()))


def test_one_of_each_joins_simhash_groups_by_counted_shingles(spark):
    """Long repeats of one line and some words of their own: fingerprints are the same, sets of shingles differ. With many own words all stay."""
    rng = random.Random(6)
    texts = []
    for k in range(3):
        line = [f"l{k}x{i}" for i in range(11)]
        for j, own in enumerate([40, 60, 80, 40, 900, 900, 900]):
            mine = [f"o{k}j{j}x{i}" for i in range(own)]
            texts.append(line * (100 + j) + mine if rng.random() < 0.5 else mine + line * 100)
    texts += [[f"p{i}" for i in range(300)] + t for t in (["a"], ["b"])]
    prints = [int(x) & (1 << 64) - 1 for x in fingerprint_many([" ".join(t).encode() for t in texts], 5)]
    counts = [Counter(tuple(t[i : i + 5]) for i in range(len(t) - 4)) for t in texts]
    n = range(len(texts))
    groups = closure(n, [(i, j) for i in n for j in n if i < j and (prints[i] ^ prints[j]).bit_count() <= 2])
    by_sets = [(i, j) for i in n for j in n if i < j and 5 * len(counts[i].keys() & counts[j].keys()) >= 4 * len(counts[i].keys() | counts[j].keys())]
    by_counts = [(i, j) for i in n for j in n if i < j and groups[i] == groups[j] and 5 * (counts[i] & counts[j]).total() >= 4 * (counts[i] | counts[j]).total()]
    wanted = sorted(set(closure(n, by_sets + by_counts).values()))
    assert len(set(groups.values())) < 8 < len(wanted) < len(set(closure(n, by_sets).values()))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in one_of_each(docs).collect()) == wanted


def test_counted_shingles():
    words = "a b c d e a b c d e a b c d e f".split()
    text = " ".join(words).encode()
    plain, counted = shingle_set(text, 5), shingle_set(text, 5, counted=True)
    assert set(plain) <= set(counted) and (len(plain), len(counted)) == (6, 12)
    assert set(counted) < set(shingle_set(text[:-2] + b" " + text, 5, counted=True))


def random_texts(rng, length):
    letters = rng.choice([b"ab", b"abcdefgh \0\xff", bytes(range(256))])
    base = [bytes(rng.choice(letters) for _ in range(rng.randrange(5 * length))) for _ in range(6)]
    texts = []
    for _ in range(rng.randrange(1, 20)):
        x = b"".join(b[i : i + rng.randrange(3 * length)] for b in rng.sample(base, 3) for i in [rng.randrange(len(b) + 1)])
        texts.append(rng.choice([x, x, b"a" * rng.randrange(300), x * 2]))
    return texts


def repeating(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    return [[seen[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in texts]


@pytest.mark.parametrize("seed", range(12))
def test_suffix_index_finds_every_repeat(seed):
    rng, length = random.Random(seed), 80
    texts = random_texts(rng, length)
    s = segments(texts, length)
    got = [[False] * max(0, len(t) - length + 1) for t in texts]
    index, k, batches = SuffixIndex(length), 0, 0
    while k < len(s["lo"]):
        e = k + rng.randrange(1, 20)
        index.add(s["h"][k:e], [texts[d][a : b + length] for d, a, b in zip(s["doc"][k:e], s["lo"][k:e], s["hi"][k:e], strict=True)], s["at"][k:e] - s["lo"][k:e])
        k, batches = e, batches + 1
    assert len(index.levels) <= max(1, batches.bit_length())
    for entry, far, near in zip(*index.runs(), strict=True):
        for i in range(near, far + 1):
            got[s["doc"][entry]][s["at"][entry] - i] = True
    assert got == repeating(texts, length)


@pytest.mark.parametrize("hot", [50_000, 1])
def test_remove_repeats(spark, hot):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefghé ") for _ in range(900))
    texts = ["".join(rng.choice("xyzü ") for _ in range(rng.randrange(900))) + passage[a:b] + "q" * rng.randrange(9) for a, b in [(0, 900), (100, 700), (300, 900), (0, 450), (0, 401)]]
    texts += ["", None, "short", "z" * 1000, "only once " * 3, passage, passage]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(11, passage, 1), (None, "n" * 500, 2)], "doc_id long, text string, spans int")
    data = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    wanted = []
    for (i, x), starts in zip(data, repeating([x for _, x in data], 400), strict=True):
        gone = merged([{"start": k, "end": k + 400} for k, y in enumerate(starts) if y])
        kept = without(x, gone)
        wanted.append((i, len(x), len(x) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
    got = remove_repeats(docs, hot=hot) if hot == 1 else None
    if got is None:
        rows = repeat_digests(docs)
        assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in rows.collect() if "\ufffd" not in r["text"])
    rows = rows.drop("text") if got is None else got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h"))
    assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, wanted))


def test_texts_may_have_any_length(spark, monkeypatch):
    """One of 17 MiB, with repeats across a border of its pieces and at its end; and many borders, against brute force."""
    long = random.Random(8).randbytes(17 << 19).hex()
    cuts = [((1 << 20) - 300, (1 << 20) + 300), (len(long) - 500, len(long))]
    docs = spark.createDataFrame([(0, long)] + [(i + 1, long[a:b]) for i, (a, b) in enumerate(cuts)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in remove_repeats(docs).select("doc_id", "spans").collect()}
    assert got == {0: cuts, 1: [(0, 600)], 2: [(0, 500)]}
    monkeypatch.setattr("deltaweave.llm.anchors.PIECE", 50)
    for seed in range(5):
        test_suffix_index_finds_every_repeat(seed)


def test_rows_that_repeat_cost_in_proportion(spark, monkeypatch):
    """Copies of one row, with equal or null ids, beside two texts that share its passage."""
    import deltaweave.llm.repeats as R

    sent = []
    monkeypatch.setattr(R, "index_matches", lambda cut, *a, own=R.index_matches: sent.append(cut.count()) or own(cut, *a))
    rng = random.Random(1)
    passage, own = ["".join(rng.choice("abcdefgh ") for _ in range(2000)) for _ in range(2)]
    for n in (20, 80):
        docs = spark.createDataFrame([(None if n == 80 else 7, own[:700] + passage)] * n + [(1, "x" + passage), (2, passage[:900])], "doc_id long, text string")
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in repeat_digests(docs).collect()}
        assert got == {None if n == 80 else 7: (2700, 2700), 1: (2001, 2000), 2: (900, 900)}
    assert sent[1] <= 5 * sent[0]


def test_drop_repeats_keeps_rows_and_letters(spark):
    passage = "é" * 300
    docs = spark.createDataFrame([(1, "a" + passage, "x"), (2, "b" + passage, "y"), (3, None, "z"), (4, "", "w")], "doc_id long, text string, row string")
    got = {r["doc_id"]: (r["text"], r["row"]) for r in drop_repeats(docs).collect()}
    assert got == {1: ("a", "x"), 2: ("b", "y"), 3: (None, "z"), 4: ("", "w")}
    assert without("aéb".encode(), [(0, 2)], whole_letters=True).decode() == "éb"
    assert remove_repeats(docs.limit(0)).count() == 0


def test_passages_of_over_fifty_words_go(spark):
    """However short their words, at other blanks too; runs of fifty words stay. Against brute force over windows of words."""
    rng = random.Random(6)
    words = [*"abcdefgh", "é", "word", "x" * 300]
    sources = [[rng.choice(words) + str(rng.randrange(9)) * (k % 2) for _ in range(n)] for k, n in enumerate([51, 50, 52, 70, 130])]
    texts = [["a"] * 60, ["a"] * 50]
    for i in range(12):
        own = [f"own{i}x{k}" for k in range(30)]
        texts.append(own[:15] + rng.choice(sources)[rng.randrange(3) :] + own[15:] + sources[i % 5])
    seen = Counter(tuple(t[i : i + 51]) for t in texts for i in range(len(t) - 50))
    wanted = []
    for t in texts:
        gone = {k for i in range(len(t) - 50) if seen[tuple(t[i : i + 51])] > 1 for k in range(i, i + 51)}
        wanted.append([w for k, w in enumerate(t) if k not in gone])
    assert any(len(t) > len(w) for t, w in zip(texts, wanted, strict=True)) and any(t == w for t, w in zip(texts, wanted, strict=True))
    docs = spark.createDataFrame([(i, (" ", "\n ")[i % 2].join(t), "x") for i, t in enumerate(texts)] + [(99, None, "y")], "doc_id long, text string, row string")
    got = {r["doc_id"]: r["text"] for r in drop_passages(docs).collect()}
    assert got.pop(99) is None
    assert [got[i].split() for i in range(len(texts))] == wanted


def test_the_pipeline_drops_short_passages(spark):
    import corpus_pipeline

    passage = " ".join(f"w{i}" for i in range(51))
    docs = spark.createDataFrame([(1, "one " + passage + " end", 1), (2, passage, 1)], "doc_id long, text string, n_chars long")
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_strings(spark, docs, "").collect()} == {1: "one  end", 2: ""}


def test_numpy_widths():
    assert np.bitwise_count(np.array([-1], np.int64).view(np.uint64))[0] == 64
