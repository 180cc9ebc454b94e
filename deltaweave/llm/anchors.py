"""Anchors: places in a text that are chosen by content, so that equal strings have them at equal places.

Every string of `length` bytes has one anchor, the leftmost of its `k`-byte strings with the least hash. Consecutive strings mostly
share theirs: a segment is a run of starts lo..hi whose strings have the same anchor, and covers the bytes lo to
hi + length. Equal strings have equal anchors, so a string can only repeat where an anchor's `k` bytes do.
"""

from __future__ import annotations

import numpy as np

K = 64
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # odd numbers that spread the bits
_POSITION = 24  # bits of a position in a buffer
PIECE = 1 << 20  # starts in one piece of a text; pieces overlap, so a text may have any length


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair, in which the order counts."""
    x = a * _P1
    x ^= x >> np.uint64(32)
    x += b
    x *= _P2
    x ^= x >> np.uint64(29)
    return x


def hashes(buffer: np.ndarray) -> np.ndarray:
    """Hashes of the K-byte string at each place where one fits."""
    h = np.ndarray((len(buffer) - 7,), "<u8", buffer.data, strides=(1,)).astype(np.uint64)
    h = join_hashes(h, h >> np.uint64(7))
    size = 8
    while size < K:
        h = join_hashes(h[:-size], h[size:])
        size *= 2
    return h


def digests(buffer: memoryview, starts: list[int], ends: list[int], places: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of a 128-bit digest of each range's bytes and the anchor's place in it."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    joined = b"".join([digest(buffer[a:b], k) for a, b, k in zip(starts, ends, places, strict=True)])
    both = np.frombuffer(joined, "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def segments(texts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """For each segment: doc (index of the text), lo, hi (starts within the text), at (the anchor), h (of the anchor), g and g2 (a digest of all its bytes and the anchor's place in them).

    A text of over PIECE starts is cut into pieces that overlap by `length` - 1 bytes: each string is in one piece, and its anchor
    is the same there. A segment across a border is two, with the same anchor and other starts, so neither repeats the other.
    """
    pieces = [(i, at, t[at : at + PIECE + length - 1]) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - length + 1), PIECE)]
    found, start, total = [], 0, 0
    for k, (_, _, piece) in enumerate(pieces):
        total += len(piece)
        if total >= PIECE or k == len(pieces) - 1:
            some = _segments([p for _, _, p in pieces[start : k + 1]], length)
            doc, shift = (np.array([p[c] for p in pieces[start : k + 1]], np.int64)[some["doc"]] for c in (0, 1))
            found.append({**some, "doc": doc, **{c: some[c] + shift for c in ("lo", "hi", "at")}})
            start, total = k + 1, 0
    return {c: np.concatenate([x[c] for x in found]) if found else np.zeros(0, np.int64) for c in ("doc", "lo", "hi", "at", "h", "g", "g2")}


def _segments(texts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """The same for texts of together less than 2 ** _POSITION bytes."""
    none = {c: np.zeros(0, np.int64) for c in ("doc", "lo", "hi", "at", "h", "g", "g2")}
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    some = np.flatnonzero(sizes >= length)
    if not some.size:
        return none
    buffer = np.frombuffer(b"".join([texts[i] for i in some]), np.uint8)
    assert len(buffer) < 1 << _POSITION
    ends = np.cumsum(sizes[some])
    starts = ends - sizes[some]
    short = hashes(buffer)
    width = length - K + 1
    low = (short >> np.uint64(_POSITION)) << np.uint64(_POSITION)
    low |= np.arange(len(low), dtype=np.uint64)
    reach = 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(short) - width + 1], low[width - reach : len(short) - reach + 1])
    anchor = (low & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
    change = np.empty(len(anchor), dtype=bool)
    change[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=change[1:])
    change[starts] = True
    last = ends - length
    valid = np.zeros(len(anchor) + 1, dtype=np.int8)  # strings that cross into the next text don't count
    np.add.at(valid, starts, 1)
    np.add.at(valid, last + 1, -1)
    lo = np.flatnonzero(change & (np.cumsum(valid[:-1], dtype=np.int8) > 0))
    doc = np.searchsorted(starts, lo, side="right") - 1
    hi = np.minimum(np.concatenate([lo[1:] - 1, [len(anchor) - 1]]), last[doc])
    at = anchor[lo]
    g, g2 = digests(buffer.data, lo.tolist(), (hi + length).tolist(), (at - lo).tolist())
    return {"doc": some[doc], "lo": lo - starts[doc], "hi": hi - starts[doc], "at": at - starts[doc], "h": short[at].view(np.int64), "g": g, "g2": g2}
