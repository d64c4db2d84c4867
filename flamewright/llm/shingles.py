"""Vectorised word shingles shared by the fingerprint and near-duplicate operators (numpy only).

Words are maximal runs of bytes other than space and \\x09-\\x0D.  A shingle is five consecutive
words; a text of one to four words has one shingle made of all of them, a text without words none.
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc

SHINGLE_WORDS = 5
_SEED = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def keys(n: int, stream: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers, a different list for each stream."""
    with np.errstate(over="ignore"):
        i = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(stream * 1_000_003)
        return mix(i * np.uint64(_SEED)) | np.uint64(1)


class Words:
    """Word hashes of a list of byte strings: ``doc`` (index of the text) and ``hash`` for each word."""

    STRETCH = 1 << 20
    _powers: dict[str, np.ndarray] = {}

    def __init__(self, texts: list[bytes]):
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        self.begins = np.cumsum(lengths) - lengths
        space = np.zeros(256, dtype=bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        gap = np.concatenate(([True], space[buf]))
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edge[0::2], edge[1::2]
        self.start, self.end = start, end
        self.doc = np.searchsorted(self.begins, start, side="right") - 1
        self.hash = np.empty(len(start), dtype=np.uint64)
        a = 0
        while a < len(start):
            # As many words as lie in STRETCH bytes, one at least, so that long texts take no more memory than their words do.
            b = max(a + 1, int(np.searchsorted(end, start[a] + self.STRETCH, side="right")))
            lo, hi = start[a], end[b - 1]
            up, down = self.powers(hi - lo + 1)
            with np.errstate(over="ignore"):
                sums = np.zeros(hi - lo + 1, dtype=np.uint64)
                np.cumsum(keys(256, 1)[buf[lo:hi]] * up[: hi - lo], out=sums[1:])
                self.hash[a:b] = mix((sums[end[a:b] - lo] - sums[start[a:b] - lo]) * down[start[a:b] - lo])
            a = b
        self.counts = np.bincount(self.doc, minlength=len(texts))

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of an odd base and of its inverse modulo 2**64."""
        if len(cls._powers.get("up", ())) < n:
            base = 0xD6E8FEB86659FD93
            for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
                with np.errstate(over="ignore"):
                    p = np.full(n, b, dtype=np.uint64)
                    p[0] = 1
                    cls._powers[name] = np.multiply.accumulate(p)
        return cls._powers["up"], cls._powers["down"]


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, shingle hash) of every shingle, in text order."""
    w = Words(texts)
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.concatenate(([True], w.doc[1:] != w.doc[:-1]))
    short = w.counts[w.doc] < SHINGLE_WORDS
    odd = keys(SHINGLE_WORDS, 2)
    h = np.zeros(n, dtype=np.uint64)
    size = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SHINGLE_WORDS):
            if j >= n:
                break
            same = w.doc[j:] == w.doc[: n - j]
            h[: n - j] += np.where(same, w.hash[j:] * odd[j], np.uint64(0))
            size[: n - j] += same
        h = mix(h + size)
    keep = (size == SHINGLE_WORDS) | (first & short)
    return w.doc[keep], h[keep]


def weighted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle hash, times it occurs), sorted by text and hash, each pair once."""
    doc, h = shingles(texts)
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))))
    return doc[new], h[new], np.diff(np.append(new, len(h)))


def similarity(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Multiset Jaccard of the shingles of left[i] and right[i]; two texts without shingles: 1."""
    n = len(left)
    da, ha, ca = weighted(left)
    db, hb, cb = weighted(right)
    total = np.bincount(da, ca, n) + np.bincount(db, cb, n)
    doc, h, c = np.concatenate((da, db)), np.concatenate((ha, hb)), np.concatenate((ca, cb))
    order = np.lexsort((h, doc))
    doc, h, c = doc[order], h[order], c[order]
    twin = np.flatnonzero((doc[1:] == doc[:-1]) & (h[1:] == h[:-1]))
    both = np.bincount(doc[twin], np.minimum(c[twin], c[twin + 1]), n)
    union = total - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def byte_sizes(texts) -> list[int]:
    """UTF-8 lengths of an Arrow string column (null: 0), without making the strings."""
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def portions(n_bytes: list[int], most: int = 1 << 18) -> list[tuple[int, int]]:
    """Slices of a batch that hold about ``most`` bytes each (a longer text has a slice of its own)."""
    out, begin, held = [], 0, 0
    for i, b in enumerate(n_bytes):
        if held and held + b > most:
            out.append((begin, i))
            begin, held = i, 0
        held += b + 1
    if begin < len(n_bytes):
        out.append((begin, len(n_bytes)))
    return out
