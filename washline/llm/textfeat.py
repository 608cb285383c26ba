"""Vectorised text features that the classifiers share (NumPy, inside tasks)."""

from __future__ import annotations

from functools import cache

import numpy as np


@cache
def letter_table() -> np.ndarray:
    """For every code point: is it a letter (Unicode alphabetic)?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser: spreads small integers over the hash space."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def letter_ngrams(text: str | None, bits: int, orders: tuple[int, ...] = (1, 2, 3)) -> np.ndarray | None:
    """Hashed counts of letter n-grams over a whole text, or None if it has no letter.

    Case is folded and each run of other characters is one space, so n-grams mark where words
    begin and end. Work and memory are linear in the text.
    """
    if not text:
        return None
    cp = code_points(text.lower())
    letters = letter_table()[cp]
    if not letters.any():
        return None
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    cp = np.where(letters, cp, np.uint32(32))[keep]
    cp = np.concatenate([np.array([32], np.uint32), cp, np.array([32], np.uint32)])
    out = np.zeros(1 << bits, np.int64)
    shift = np.uint32(32 - bits)
    for n in orders:
        if len(cp) < n:
            continue
        h = np.full(len(cp) - n + 1, n, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) + cp[k:len(cp) - n + 1 + k]
        out += np.bincount(mixed(h) >> shift, minlength=1 << bits)
    return out


def hellinger(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: a vector of length 1 that long texts do not dominate."""
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)
