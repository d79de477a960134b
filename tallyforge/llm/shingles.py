"""Sets of word shingles as sorted 64-bit hashes, for many documents at once."""

from __future__ import annotations

import numpy as np

from tallyforge.llm.shared import ASCII_SPACE, hash_ranges, mix

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[ASCII_SPACE] = True


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and n + 1 word numbers at which the documents begin."""
    inside = ~_SPACE[buf]
    edge = inside.copy()
    if len(buf):
        edge[1:] = inside[1:] & ~inside[:-1]
        first = off[:-1][off[:-1] < off[1:]]
        edge[first] = inside[first]
        ends = inside.copy()
        ends[:-1] = inside[:-1] & ~inside[1:]
        last = off[1:][off[:-1] < off[1:]] - 1
        ends[last] = inside[last]
    else:
        ends = inside
    starts, ends = np.flatnonzero(edge), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, off)


def shingle_sets(buf: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and n + 1 offsets.

    A-Z count as a-z. A document with fewer words has its whole sequence as one shingle; one without words has none.
    """
    buf = _LOWER[buf]
    starts, ends, at = word_spans(buf, off)
    code = hash_ranges(buf, starts, ends - starts)
    n = np.diff(at)
    count = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
    own = np.repeat(np.arange(len(n)), count)
    first = at[:-1][own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        total = np.zeros(len(own), np.uint64)
        for k in range(words):
            has = first + k < at[1:][own]
            w = np.where(has, code[np.minimum(first + k, max(len(code) - 1, 0))], np.uint64(0)) if len(code) else total
            total = mix(total + w + np.uint64(k + 1))
    edges = np.r_[0, np.cumsum(count)]
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        total[i:j].sort()
    new = np.ones(len(own), bool)
    new[1:] = (total[1:] != total[:-1]) | (own[1:] != own[:-1])
    total, own = total[new], own[new]
    return total, np.searchsorted(own, np.arange(len(off)))
