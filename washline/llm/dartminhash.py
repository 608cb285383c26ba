"""DartMinHash: weighted MinHash signatures from hashed darts (NumPy, one batch of texts at a time).

Every possible element (a hashed word shingle) owns a half-plane weight x rank. Darts fall into it
as a Poisson process of density 1: the half-plane is cut into rectangles (weight intervals
[0,1), [1,2), [2,4), ... by rank intervals [0,r), [r,2r), [2r,4r), ...), and a hash of the element
and the rectangle says how many darts it holds and where. An element of weight w sees the darts
below w. Each dart belongs to one of ``k`` coordinates by hash; a document keeps, per coordinate,
the dart of lowest rank. Two documents keep the same dart with probability equal to their weighted
Jaccard similarity. Ranks are explored only up to a bound that gives a document about
``k ln k + 4k`` darts whatever its length, so work is linear in the text plus a constant.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_P = U(0x9E3779B97F4A7C15)
_FIRST = 1 / 64  # upper end of the first rank interval
_RANKS = 21  # rank intervals: up to 2**14
_NONE = U(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every whitespace-separated word and the index of its text."""
    if not texts:
        return np.zeros(0, U), np.zeros(0, np.int64)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~_SPACE[data]
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & ~before)
    if not len(start):
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, start)
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), _P))
    h = np.add.reduceat((data[at].astype(U) + U(1)) * power[place], first)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return mix(h + length.astype(U)), np.searchsorted(ends, start, side="right")


def shingles(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the index of their text.

    A text of fewer words, but at least one, has a single shingle: all its words.
    """
    words, doc = word_hashes(texts)
    if not len(words):
        return words, doc
    total = np.bincount(doc, minlength=len(texts))
    begin = np.concatenate([[0], np.cumsum(total)])[:-1]
    room = (begin + total)[doc] - np.arange(len(words))  # words from here to the end of the text
    starts = np.flatnonzero((room >= size) | ((total[doc] < size) & (room == total[doc])))
    h = np.full(len(starts), size, U)
    for j in range(size):
        ok = room[starts] > j
        nxt = words[np.minimum(starts + j, len(words) - 1)]
        h = np.where(ok, mix(h * _P + nxt), h)
    return h, doc[starts]


def weighted(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (element, text) pairs with their counts."""
    order = np.argsort(mix(hashes + doc.astype(U) * _P), kind="stable")
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return hashes[at], doc[at], np.diff(np.append(at, len(hashes)))


def multiset(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements as a set: the n-th occurrence of a shingle in a text is an element of its own.

    The Jaccard similarity of these sets is the weighted similarity of the counts.
    """
    x, d, n = weighted(hashes, doc)
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return mix(np.repeat(x, n) + nth.astype(U) * U(0xD6E8FEB86659FD93)), np.repeat(d, n)


@cache
def _poisson(area: float) -> np.ndarray:
    """Thresholds on 32 bits: a draw above the n-th means more than n darts."""
    top = int(area + 8 * math.sqrt(area) + 12)
    n = np.arange(top)
    log = n * math.log(area) - area - np.array([math.lgamma(i + 1) for i in range(top)])
    return (np.minimum(1, np.cumsum(np.exp(log))) * 4294967295).astype(np.uint32)


def _throw(best, x, doc, weight, bound, k):
    """Lower ``best`` (texts x coordinates) by all darts whose rank interval starts below ``bound``."""
    for b in range(_RANKS):
        low = 0.0 if b == 0 else _FIRST * 2.0 ** (b - 1)
        wide = _FIRST if b == 0 else low
        near = bound[doc] > low
        if not near.any():
            break
        for a in range(64):
            floor = 0 if a == 0 else 1 << (a - 1)
            span = 1 if a == 0 else floor
            use = np.flatnonzero(near & (weight > floor))
            if not len(use):
                break
            h = mix(x[use] + U((a * 64 + b + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
            count = np.searchsorted(_poisson(span * wide), (h >> U(32)).astype(np.uint32))
            hit = np.flatnonzero(count)
            count = count[hit]
            which = np.repeat(hit, count)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            g = mix(h[which] + (nth + 1).astype(U) * _P)
            own = use[which]
            if span > 1 or floor > 0:  # the rectangle may reach above the weight
                height = floor + span * ((mix(g ^ U(0x5851F42D4C957F2D)) >> U(11)) / 9007199254740992.0)
                seen = height < weight[own]
                g, own = g[seen], own[seen]
            rank = low + wide * ((g >> U(32)) / 4294967296.0)
            g = mix(g)
            dart = ((rank * 2.0 ** 18).astype(U) << U(32)) | (g >> U(32))
            np.minimum.at(best, doc[own] * k + (g & U(0xFFFFFFFF)).astype(np.int64) % k, dart)


def signatures(texts: list[bytes], k: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(texts x k) 32-bit dart names, and the number of shingles of each text (0: all names 0)."""
    h, doc = shingles(texts, size)
    total = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    best = np.full(len(texts) * k, _NONE)
    x, doc, weight = weighted(h, doc)
    bound = (k * math.log(k) + 4 * k) / np.maximum(1, total)
    while len(x):
        _throw(best, x, doc, weight, bound, k)
        missing = (best.reshape(-1, k) == _NONE).any(1) & (total > 0)
        again = missing[doc]
        x, doc, weight = x[again], doc[again], weight[again]
        bound = bound * 2  # a coordinate without a dart: look at higher ranks, for these texts
    best = best.reshape(-1, k)
    return np.where(best == _NONE, U(0), best & U(0xFFFFFFFF)).astype(np.uint32), total


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts x bands) hashes of consecutive groups of ``rows`` coordinates."""
    h = np.broadcast_to(np.arange(1, bands + 1).astype(U) * _P, (len(sig), bands)).copy()
    for j in range(rows):
        h = mix(h * U(0xD6E8FEB86659FD93) + sig[:, j::rows][:, :bands].astype(U))
    return h
