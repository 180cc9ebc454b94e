"""Byte-pair encoding by a segment tree over adjacent pair ranks, and its decoding.

A word's symbols form a linked list. Leaf i of the tree holds (rank, i) of the pair that starts at symbol i, inner nodes
the minimum of their children, so the root is the leftmost pair of lowest rank. A merge changes three leaves (the pair
itself, the one before, the one that vanished), each a logarithmic point update, until the root says that no pair can merge.

Many short words are merged in step: one tree each, as rows of one array. A long word has a tree of its own.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PAD = 65535  # no symbol
NONE = np.int64(1) << 60  # no pair
ROW_SYMBOLS = 65  # up to so many bytes, a word is a row of a shared array
SLOTS = 18  # log2 of the pair table's size
#: Ranges of characters whose class no Unicode version since 4.0 has changed and that aren't white space but for the ASCII blanks.
STABLE = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in (
    (0x0, 0x1B), (0x20, 0x84), (0x86, 0x9F), (0xA1, 0x220), (0x410, 0x481), (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x905, 0x939), (0x2010, 0x2027),
    (0x2030, 0x2052), (0x20A0, 0x20B1), (0x3001, 0x3020), (0x3041, 0x3094), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFF01, 0xFF5E),
))
#: Fixed: how the vocabulary that drops blanks splits text before merging, but for letters, which stay together.
SHORT_FORMS = "'s|'t|'re|'ve|'m|'ll|'d"
MARKS = r"\pN|[^\x09-\x0d\x20\pL\pN]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabularies: itself, or the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """Vocabulary and merges of a BPE model, as arrays."""

    def __init__(self, model: dict, added: list[dict]):
        vocab = model["vocab"]
        tail = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.first = np.array([vocab[x] for x in letters], dtype=np.int64)
        self.last = np.array([vocab[x + tail] for x in letters], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.result = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.uint64)
        self.slot_key, self.slot_rank = np.full(1 << SLOTS, 2**64 - 1, dtype=np.uint64), np.full(1 << SLOTS, -1, dtype=np.int64)
        for rank in range(len(keys) - 1, -1, -1):  # of equal pairs the lowest rank stays
            at = int(self._home(keys[rank : rank + 1])[0])
            while self.slot_rank[at] >= 0 and self.slot_key[at] != keys[rank]:
                at = (at + 1) % (1 << SLOTS)
            self.slot_key[at], self.slot_rank[at] = keys[rank], rank
        byte_of = {x: b for b, x in enumerate(letters)}
        by_id = {i: x for x, i in vocab.items()} | {x["id"]: x["content"] for x in added}
        self.bytes_of = [bytes(byte_of[c] for c in by_id[i].removesuffix(tail) if c in byte_of) if i in by_id else b"" for i in range(max(by_id) + 1)]
        self.special = {x["content"]: x["id"] for x in added}

    @staticmethod
    def _home(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        keys = left.astype(np.uint64) << np.uint64(16) | right.astype(np.uint64)
        at = self._home(keys)
        rank, found = self.slot_rank[at], self.slot_key[at]
        open_ = np.flatnonzero((found != keys) & (rank >= 0))
        rank[(found != keys)] = -1
        while open_.size:
            at[open_] = (at[open_] + 1) % (1 << SLOTS)
            found, other = self.slot_key[at[open_]], self.slot_rank[at[open_]]
            rank[open_] = np.where(found == keys[open_], other, -1)
            open_ = open_[(found != keys[open_]) & (other >= 0)]
        return rank

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word."""
        out = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > ROW_SYMBOLS:
                out[i] = self._one(w).astype("<u4").tobytes()
            elif w:
                groups.setdefault(max(1, (len(w) - 1).bit_length() and 1 << (len(w) - 2).bit_length()), []).append(i)
        for pairs, members in groups.items():
            for at in range(0, len(members), 2048):
                part = members[at : at + 2048]
                for i, ids in zip(part, self._rows([words[i] for i in part], pairs), strict=True):
                    out[i] = ids
        return out

    def _symbols(self, joined: bytes, ends: np.ndarray) -> np.ndarray:
        data = np.frombuffer(joined, np.uint8)
        ids = self.first[data]
        ids[ends - 1] = self.last[data[ends - 1]]
        return ids

    def _rows(self, words: list[bytes], pairs: int) -> list[bytes]:
        """All words in step; each has a tree of `pairs` leaves (a power of two) in its row."""
        n = np.array([len(w) for w in words])
        rows, width = len(words), pairs + 1
        column = np.arange(width)
        used = column < n[:, None]
        sym = np.full((rows, width + 1), PAD, dtype=np.int64)
        sym[:, :width][used] = self._symbols(b"".join(words), np.cumsum(n))
        after = np.broadcast_to(np.arange(1, width + 2), (rows, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (rows, width + 1)).copy()
        tree = np.full((rows, 2 * pairs), NONE, dtype=np.int64)
        rank = self.ranks(sym[:, :pairs].ravel(), sym[:, 1:width].ravel()).reshape(rows, pairs)
        tree[:, pairs:] = np.where(rank >= 0, rank << 8 | np.arange(pairs), NONE)
        for level in range(pairs.bit_length() - 2, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        gone = np.zeros((rows, width + 1), dtype=bool)
        flat_sym, flat_after, flat_before, flat_tree, flat_gone = (x.ravel() for x in (sym, after, before, tree, gone))
        active = np.flatnonzero(tree[:, 1] < NONE)
        while active.size:
            row, node = active * (width + 1), active * (2 * pairs)
            root = flat_tree[node + 1]
            at = root & 255
            merged = self.result[root >> 8]
            right = flat_after[row + at]
            third = np.minimum(flat_after[row + right], width)
            left = flat_before[row + at]
            flat_sym[row + at] = merged
            flat_gone[row + right] = True
            flat_after[row + at] = third
            flat_before[row + third] = at
            head = np.maximum(left, 0)
            rank = self.ranks(np.concatenate([merged, np.where(left >= 0, flat_sym[row + head], PAD)]), np.concatenate([flat_sym[row + third], merged]))
            places = np.concatenate([at, head])
            keys = np.where(rank >= 0, rank << 8 | places, NONE)
            own, prior = keys[: active.size], keys[active.size :]
            flat_tree[node + pairs + np.minimum(right, pairs - 1)] = NONE
            flat_tree[node + pairs + np.where(left >= 0, head, at)] = prior
            flat_tree[node + pairs + at] = own
            for leaf in (np.minimum(right, pairs - 1), head, at):
                up = leaf + pairs
                for _ in range(pairs.bit_length() - 1):
                    up = up >> 1
                    flat_tree[node + up] = np.minimum(flat_tree[node + 2 * up], flat_tree[node + 2 * up + 1])
            active = active[flat_tree[node + 1] < NONE]
        keep = used & ~gone[:, :width]
        packed = sym[:, :width][keep].astype("<u4").tobytes()
        ends = (4 * np.cumsum(keep.sum(1))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _one(self, word: bytes) -> np.ndarray:
        """A long word, on its own tree."""
        sym = self._symbols(word, np.array([len(word)])).tolist()
        n = len(sym)
        size = 1 << (n - 2).bit_length()
        none, shift = int(NONE), size.bit_length()
        rank = self.ranks(np.array(sym[:-1]), np.array(sym[1:])).tolist()
        tree = [none] * size + [r << shift | i if r >= 0 else none for i, r in enumerate(rank)] + [none] * (size - n + 1)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        known: dict[int, int] = {}
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, a: int, b: int) -> None:
            key = a << 16 | b
            if key not in known:
                known[key] = int(self.ranks(np.array([a]), np.array([b]))[0])
            store(i, known[key] << shift | i if known[key] >= 0 else none)

        def store(i: int, key: int) -> None:
            i += size
            tree[i] = key
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low

        while tree[1] < none:
            at, new = tree[1] & ((1 << shift) - 1), int(self.result[tree[1] >> shift])
            right, left = after[at], before[at]
            third = after[right]
            sym[at], sym[right], after[at] = new, -1, third
            if right < n - 1:
                store(right, none)
            if third < n:
                before[third] = at
                put(at, new, sym[third])
            else:
                store(at, none)
            if left >= 0:
                put(left, sym[left], new)
        return np.array([x for x in sym if x >= 0], dtype=np.int64)


class Memory:
    """The latest words and their ids: two generations of about `most` words each."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, words: set[str]) -> set[str]:
        """Those of `words` that aren't known; the others are in `young` from here on, until the next call."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        out = words.difference(self.young)
        if again := out & self.old.keys():
            old = self.old
            self.young.update({w: old[w] for w in again})
            out -= again
        return out


class Codec:
    """Texts to ids and back, as the library for `tokenizer` (the text of its json file) does it; special strings in a text are special tokens, and none is added.

    Ids are packed as little-endian unsigned 32-bit integers. Words between blanks are encoded once while they are remembered.
    """

    def __init__(self, tokenizer: str, words: int = 250_000):
        import regex

        spec = json.loads(tokenizer)
        self.merges = Merges(spec["model"], spec["added_tokens"])
        self.by_word = bool(spec["model"].get("end_of_word_suffix"))  # blanks are dropped, not kept in front of words
        patterns = [x["pattern"]["Regex"] for x in spec["pre_tokenizer"].get("pretokenizers", []) if x["type"] == "Split"]
        #: Fixed: how the byte-level vocabulary splits text before merging.
        self.split = regex.compile(patterns[0] if patterns else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.merges.special, key=len, reverse=True))) + ")") if self.merges.special else None
        self.blank_run = regex.compile(r" (?:\s|$)").search
        self.blanks = regex.compile(r"[\t-\r\x20\x85\p{Z}]+")
        self.words, self.tokens = Memory(words), Memory(words)

    @staticmethod
    def _prepared(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # the library lower-cases letter by letter
        return text.lower()

    def _split(self, word: str) -> list[str]:
        """The tokens before merging of a word and the blank before it; a word of letters, or one with a mark behind, needs no pattern."""
        if word.isalpha():
            return [" " + word]
        if word[-1:] in ".,;:!?" and word[:-1].isalpha():
            return [" " + word[:-1], word[-1]]
        return self.split(" " + word)

    def _tokens(self, pieces: dict[str, list[str]]) -> dict[str, bytes]:
        """Ids of each piece, given its tokens before merging."""
        missing = list(self.tokens.missing(set().union(*pieces.values()) if pieces else set()))
        known = self.tokens.young
        known.update(zip(missing, self.merges.encode([t.encode() for t in missing]), strict=True))
        out = {p: known[t[0]] if len(t) == 1 else b"".join(map(known.__getitem__, t)) for p, t in pieces.items()}
        for t in missing:
            if len(t) > 64:
                del known[t]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.by_word:
            return self._by_words(texts)
        lists: list[list[str] | None] = []
        odd: dict[int, list[str]] = {}
        heads: dict[str, list[str]] = {}
        for i, text in enumerate(texts):
            parts = self.special.split(text) if self.special and "<|" in text else [text]
            if len(parts) > 1 or self.blank_run(text):
                odd[i] = parts
                lists.append(None)
            else:
                head, *rest = text.split(" ")
                heads[head] = self.split(head)
                lists.append([head, *rest])
        words = [x[1:] for x in lists if x]
        missing = self.words.missing(set().union(*words) if words else set())
        known = self.words.young
        known.update(self._tokens({w: self._split(w) for w in missing}))
        first = self._tokens(heads)
        out = []
        for i, words in enumerate(lists):
            if words is None:
                out.append(self._odd(odd[i]))
            elif not words:
                out.append(b"")
            else:
                out.append(first[words[0]] + b"".join(map(known.__getitem__, words[1:])))
        for w in missing:
            if len(w) > 40 or "\n" in w:
                del known[w]
        return out

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """For vocabularies that drop blanks: tokens before merging don't depend on their neighbours, so all texts go as one column.

        Blanks are put around all that isn't a letter, and the column is split at them. Texts with characters that the two
        pattern engines might class differently, or with special strings, go one by one.
        """
        column = pa.array([self._prepared(x) for x in texts], pa.large_string())
        odd = pc.or_(pc.match_substring(column, "<|"), pc.match_substring_regex(column, f"[^{STABLE}]"))
        column = pc.if_else(odd, "", column)
        spaced = pc.replace_substring_regex(column, MARKS, r" \0 ")
        if (quoted := pc.match_substring(column, "'")).true_count:
            spaced = pc.replace_with_mask(spaced, quoted, pc.replace_substring_regex(column.filter(quoted), f"{SHORT_FORMS}|{MARKS}", r" \0 "))
        lists = pc.ascii_split_whitespace(spaced)
        coded = lists.values.dictionary_encode()
        tokens = coded.dictionary.cast(pa.large_binary()).to_pylist()
        missing = list(self.words.missing(set(tokens)))
        known = self.words.young
        known.update(zip(missing, self.merges.encode(missing), strict=True))
        ids = pa.array(list(map(known.__getitem__, tokens)), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[lists.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        out = [bytes(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._odd(self.special.split(texts[i]) if self.special else [texts[i]])
        for w in missing:
            if len(w) > 64:
                del known[w]
        return out

    def _odd(self, parts: list[str]) -> bytes:
        """A text with special strings (every second part) or runs of blanks."""
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.merges.special[part].to_bytes(4, "little"))
            elif part:
                text = self._prepared(self.blanks.sub(" ", part)) if self.by_word else part
                out.append(self._tokens({"": self.split(text)})[""])
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        of: Callable[[int], bytes] = self.merges.bytes_of.__getitem__
        return b"".join(map(of, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")
