"""Simple-8b: as many ids per 64-bit word as fit, named by a four-bit selector, with an escape for ids beyond 60 bits.

Selectors 1 to 14 hold (count, width) pairs that fill 60 bits; the last word of a block may be partly empty, which the block's id count
tells. Selector 0 is the escape: the whole next word is one id. Encoding finds the greedy packing from sliding maxima of the ids' widths;
decoding treats all words of one selector at once.
"""

from __future__ import annotations

import numpy as np

LAYOUTS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
U = np.uint64


def _choices(ids: np.ndarray) -> np.ndarray:
    """For each position the selector of the fullest word that can start there (0: escape)."""
    n = len(ids)
    width = np.zeros(n, np.int8)
    rest = ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= (U(1) << U(step))
        width[big] += step
        rest[big] >>= U(step)
    width += 1
    best = np.zeros(n, np.int8)
    for selector in range(len(LAYOUTS), 0, -1):  # from one id a word to sixty
        count, bits = LAYOUTS[selector - 1]
        fits = np.append(0, np.cumsum(width > bits))
        end = np.minimum(np.arange(n) + count, n)
        best[fits[end] == fits[:n]] = selector
    return best


def encode(ids: np.ndarray) -> np.ndarray:
    """Words (uint64) of the ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    if not len(ids):
        return np.zeros(0, np.uint64)
    best = _choices(ids)
    jump = np.array([1, *(c for c, _ in LAYOUTS)])[best].tolist()
    starts, at, n = [], 0, len(ids)
    while at < n:
        starts.append(at)
        at += jump[at]
    start = np.array(starts)
    selector = best[start]
    place = np.arange(len(start)) + np.append(0, np.cumsum(selector == 0))[:-1]
    out = np.zeros(len(start) + int((selector == 0).sum()), np.uint64)
    padded = np.append(ids, np.zeros(60, np.uint64))
    out[place] = selector.astype(np.uint64) << U(60)
    escaped = selector == 0
    out[place[escaped] + 1] = ids[start[escaped]]
    for s, (count, bits) in enumerate(LAYOUTS, 1):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            first = start[mine]
            word = out[place[mine]]
            for k in range(count):
                word |= padded[first + k] * (first + k < n) << U(k * bits)
            out[place[mine]] = word
    return out


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ids that the words hold."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> U(60)).astype(np.int8)
    is_word = np.ones(len(words), bool)
    for at in np.flatnonzero(selector == 0):  # few: the word after an escape is no word of its own
        if is_word[at] and at + 1 < len(words):
            is_word[at + 1] = False
    place = np.flatnonzero(is_word)
    selector = selector[place]
    counts = np.array([1, *(c for c, _ in LAYOUTS)])[selector]
    ends = np.cumsum(counts)
    starts = ends - counts
    out = np.zeros(int(ends[-1]) + 60, np.uint64)
    escaped = selector == 0
    if escaped.any():
        out[starts[escaped]] = words[place[escaped] + 1]
    for s, (count, bits) in enumerate(LAYOUTS, 1):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            word, first, mask = words[place[mine]], starts[mine], U((1 << bits) - 1)
            for k in range(count):
                out[first + k] = (word >> U(k * bits)) & mask
    return out[:n]
