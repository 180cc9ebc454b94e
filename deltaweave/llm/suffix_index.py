"""A logarithmic family of sparse suffix arrays.

An entry is a segment (see `anchors`): the bytes around an anchor, with the starts whose strings of `length` bytes it can hold. A
level keeps its entries in two sorted orders: by anchor and what follows it, and by anchor and what precedes it, read
backwards. A string that starts i bytes before the anchor repeats if another entry agrees in the i bytes before and the
`length` - i bytes behind: both are runs of the sorted orders whose neighbours' common prefixes are long enough.

A new batch becomes a level of its own. It is scanned within itself and, merged in order, against every other level;
levels of equal rank are then merged into one of the next rank, so n batches leave at most log2(n) + 1 levels.
"""

from __future__ import annotations

import numpy as np

from .anchors import K


class Level:
    """Entries in both orders: keys (8 bytes of the anchor's hash, then the text) and the entries they belong to."""

    def __init__(self, keys: tuple[np.ndarray, np.ndarray], entries: tuple[np.ndarray, np.ndarray], rank: int = 0):
        self.keys, self.entries, self.rank = keys, entries, rank

    def anchors(self) -> np.ndarray:
        return np.unique(self.keys[0].astype("S8") if len(self.keys[0]) else self.keys[0])

    def among(self, anchors: np.ndarray) -> Level:
        kept = [np.isin(k.astype("S8"), anchors) for k in self.keys]
        return Level((self.keys[0][kept[0]], self.keys[1][kept[1]]), (self.entries[0][kept[0]], self.entries[1][kept[1]]), self.rank)

    def merged(self, other: Level) -> Level:
        """Both levels' entries, by merging the sorted orders."""
        at = [np.searchsorted(a, b, side="right") for a, b in zip(self.keys, other.keys, strict=True)]
        keys = tuple(np.insert(a, i, b) for a, i, b in zip(self.keys, at, other.keys, strict=True))
        entries = tuple(np.insert(a, i, b) for a, i, b in zip(self.entries, at, other.entries, strict=True))
        return Level(keys, entries, max(self.rank, other.rank) + 1)


def _common(keys: np.ndarray) -> np.ndarray:
    """The common prefix of each key and the one before, without the 8 bytes of the anchor; below 0 where the anchors differ."""
    n, width = len(keys), keys.dtype.itemsize
    rows = keys.view(np.uint8).reshape(n, width)
    out = np.full(n, -8, dtype=np.int64)
    for at in range(1, n, 16384):
        differ = rows[at : at + 16384] != rows[at - 1 : min(n, at + 16384) - 1]
        first = differ.argmax(axis=1)
        first[~differ.any(axis=1)] = width
        out[at : at + 16384] = first - 8
    return out


class SuffixIndex:
    """Which strings of `length` bytes repeat among all entries added so far."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[Level] = []
        self.least = np.zeros(0, np.int64)  # of each entry: the nearest and the farthest start before the anchor,
        self.most = np.zeros(0, np.int64)
        self.place = np.zeros(0, np.int64)  # and where its starts' flags begin, nearest first
        self.found = np.zeros(0, bool)

    def add(self, hashes: np.ndarray, texts: list[bytes], before: np.ndarray) -> None:
        """Entries: the anchor's hash, the segment's bytes, and how many of them precede the anchor."""
        first = len(self.least)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        least = self.length - (sizes - before)
        counts = before - least + 1
        self.place = np.concatenate([self.place, len(self.found) + np.cumsum(counts) - counts])
        self.least, self.most = np.concatenate([self.least, least]), np.concatenate([self.most, before])
        self.found = np.concatenate([self.found, np.zeros(int(counts.sum()), bool)])
        heads = [h.to_bytes(8, "big", signed=True).replace(b"\0", b"\1") for h in hashes.tolist()]  # no zero byte: numpy's strings end at those
        right, left = self.length + 8, self.length - K + 8
        behind = b"".join((h + t[b:]).ljust(right, b"\0") for h, t, b in zip(heads, texts, before.tolist(), strict=True))
        ahead = b"".join((h + t[:b][::-1]).ljust(left, b"\0") for h, t, b in zip(heads, texts, before.tolist(), strict=True))
        keys = [np.frombuffer(behind, f"S{right}"), np.frombuffer(ahead, f"S{left}")]
        orders = [np.argsort(k, kind="stable") for k in keys]
        new = Level((keys[0][orders[0]], keys[1][orders[1]]), (orders[0] + first, orders[1] + first))
        self._scan(new)
        own = new.anchors()
        for level in self.levels:
            met = np.intersect1d(own, level.anchors())
            if met.size:
                self._scan(level.among(met).merged(new.among(met)))
        self.levels.append(new)
        while len(self.levels) > 1 and self.levels[-1].rank >= self.levels[-2].rank:
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merged(last)

    def _scan(self, level: Level) -> None:
        n = len(level.entries[0])
        if n < 2:
            return
        ids = np.sort(level.entries[0])
        places = [np.searchsorted(ids, e) for e in level.entries]
        behind, ahead = (_common(k) for k in level.keys)
        least, most, flags = self.least[ids], self.most[ids], self.place[ids] - self.least[ids]
        run = [np.empty(n, np.int64), np.empty(n, np.int64)]
        for i in range(int(least.min()), int(most.max()) + 1):
            some = np.flatnonzero((least <= i) & (most >= i))
            if len(some) < 2:
                continue
            run[0][places[0]] = np.cumsum(behind < self.length - i)
            run[1][places[1]] = np.cumsum(ahead < i)
            both = run[0][some] * (n + 1) + run[1][some]
            order = np.argsort(both)
            same = both[order][1:] == both[order][:-1]
            twice = np.zeros(len(some), bool)
            twice[1:] = same
            twice[:-1] |= same
            self.found[(flags[some] + i)[order[twice]]] = True

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of repeating starts: entry, and the farthest and the nearest start before its anchor."""
        padded = np.concatenate([[False], self.found, [False]])
        edges = np.diff(padded.astype(np.int8))
        breaks = np.zeros(len(self.found) + 1, bool)
        breaks[self.place] = True  # a run ends where another entry's flags begin
        begin = np.flatnonzero((edges[:-1] == 1) | (breaks[:-1] & self.found))
        end = np.flatnonzero((edges[1:] == -1) | (breaks[1:] & self.found)) if len(self.found) else np.zeros(0, np.int64)
        entry = np.searchsorted(self.place, begin, side="right") - 1
        offset = self.least[entry] - self.place[entry]
        return entry, end + offset, begin + offset
