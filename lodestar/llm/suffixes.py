"""Suffix arrays by the difference cover {1, 2} mod 3, in numpy."""

from __future__ import annotations

import numpy as np


def names(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks, from 1, of rows of non-negative numbers in lexicographic order; and how many."""
    key = columns[0]
    for c in columns[1:]:
        wide = int(c.max()) + 1
        if int(key.max()) >= (1 << 62) // wide:
            key = np.unique(key, return_inverse=True)[1]
        key = key * wide + c
    found, rank = np.unique(key, return_inverse=True)
    return rank + 1, len(found)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of text (positive integers) in ascending order.

    Sorts the triples at positions 1 and 2 mod 3, recurses on their names while some are equal, sorts
    the rest by first symbol and the rank of what follows, and merges.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.concatenate([text.astype(np.int64), np.zeros(4, np.int64)])
    extra = n % 3 == 1  # a sampled empty suffix keeps the halves of the recursion apart
    one = np.arange(1, n + extra, 3)
    two = np.arange(2, n, 3)
    sampled = np.concatenate([one, two])
    name, different = names(t[sampled], t[sampled + 1], t[sampled + 2])
    rank = np.zeros(n + 4, np.int64)
    if different == len(sampled):
        order = np.empty(len(sampled), np.int64)
        order[name - 1] = sampled
    else:
        order = sampled[suffix_array(name)]
    rank[order] = np.arange(1, len(order) + 1)
    wide = len(order) + 2
    zero = np.arange(0, n, 3)
    by = t[zero] * wide + rank[zero + 1]
    at = np.argsort(by, kind="stable")
    zero, by = zero[at], by[at]
    first, second = order[order % 3 == 1], order[order % 3 == 2]
    before = np.searchsorted(t[first] * wide + rank[first + 1], by)
    pair = int(t.max()) + 1
    if pair * pair < (1 << 62) // wide:
        deep = lambda i: (t[i] * pair + t[i + 1]) * wide + rank[i + 2]
        before += np.searchsorted(deep(second), deep(zero))
    elif len(second):
        both = np.concatenate([second, zero])
        code, _ = names(t[both], t[both + 1], rank[both + 2])
        before += np.searchsorted(code[: len(second)], code[len(second) :])
    out = np.full(len(order) + len(zero), -1, np.int64)
    out[before + np.arange(len(zero))] = zero
    out[out < 0] = order
    return out[out < n]
