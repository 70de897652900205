"""Character n-gram models over hashed buckets.

A model is a table of fixed size (classes x buckets), whatever the corpus, so it may be collected and
sent to every task.
"""

from __future__ import annotations

import numpy as np

#: Separates the texts of a batch; part of no n-gram.
_GAP = "\x00"


def hashed_codes(codes: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text number, first place) of every n-gram of code points, in order; a zero separates texts. buckets is a power of two."""
    if len(codes) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    width = len(codes) - n + 1
    h = np.zeros(width, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x100000001B3) + codes[k : k + width]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    before = np.concatenate(([0], np.cumsum(codes == 0)))
    inside = np.flatnonzero(before[n:] == before[:width])  # no separator in the n-gram
    return (h[inside] >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64), before[inside], inside


def hashed(texts: list[str], n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every n-gram of the texts, in order."""
    codes = np.frombuffer(_GAP.join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return hashed_codes(codes, n, buckets)[:2]


def count_texts(texts: list[str], n: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in the texts."""
    return np.bincount(hashed(texts, n, buckets)[0], minlength=buckets)


def text_scores(texts: list[str], n: int, logp: np.ndarray, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(sum of log probabilities per text and class, n-grams per text); a few texts at a time, so that the work stays in the cache."""
    table = np.ascontiguousarray(logp.T)
    sums, grams = np.zeros((len(texts), len(logp))), np.zeros(len(texts), np.int64)
    for at in range(0, len(texts), chunk):
        some = texts[at : at + chunk]
        bucket, number = hashed(some, n, logp.shape[1])
        count = np.bincount(number, minlength=len(some))
        grams[at : at + chunk] = count
        full = np.flatnonzero(count)
        if len(full):
            starts = np.concatenate(([0], np.cumsum(count[full])[:-1]))
            sums[at + full] = np.add.reduceat(table[bucket], starts, axis=0)
    return sums, grams
