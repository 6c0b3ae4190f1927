"""Pairs of lines at or above a Ratcliff-Obershelp ratio: upper bounds first, the exact ratio for what they leave.

A ratio of 2 M / (m + n) has M matched characters, which are a common subsequence. So M is at most the sum of the lesser letter counts; and as
the matched characters lie in at most m + n - 2 M + 1 stretches, the lines share at least 3 M - m - n - 1 pairs of neighbouring characters.
Counts by hashed bins only raise the bounds. For the same reason they share at least M less twice those stretches triples of neighbouring
characters: an index of the right side's triples counts these for all pairs at once and leaves few pairs for the other bounds. Where that number
can be zero (short lines, low ratios) pairs of neighbours are counted instead, or every pair of like length is looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa

LETTER_BINS, PAIR_BINS, GRAM_BINS, CELLS, SLACK = 32, 256, 1 << 16, 1 << 22, 1e-9


def counts(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, letters by bin, pairs of neighbouring letters by bin) of each line."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(lines)), size)
    letters = np.bincount(owner * LETTER_BINS + code % LETTER_BINS, minlength=len(lines) * LETTER_BINS)
    inside = owner[1:] == owner[:-1]
    pair = ((code[:-1] * 31 + code[1:]) % PAIR_BINS)[inside]
    pairs = np.bincount(owner[1:][inside] * PAIR_BINS + pair, minlength=len(lines) * PAIR_BINS)
    return size, letters.reshape(-1, LETTER_BINS).astype(np.int32), pairs.reshape(-1, PAIR_BINS).astype(np.int32)


def grams(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, bin) of every run of ``width`` neighbouring characters."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(lines)), size)
    n = max(0, len(code) - width + 1)
    mixed = np.zeros(n, np.int64)
    for k in range(width):
        mixed = (mixed * 40503 + code[k : k + n]) & 0x7FFFFFFF
    inside = owner[:n] == owner[width - 1 : width - 1 + n]
    return owner[:n][inside], ((mixed * 2654435761) >> 12 & (GRAM_BINS - 1))[inside]


def common(x: str, masks: dict[str, int], n: int, least: int) -> bool:
    """Whether x has a common subsequence of the least length with the line of n characters whose places by character are ``masks``.

    Such a one leaves out at most so many characters of either line, so only places near each other match, and a prefix of x with more left
    out ends the search.
    """
    m, get, s, matched = len(x), masks.get, (1 << n) - 1, 0
    full, skip, ahead = s, m - least, n - least
    if skip < 0 or ahead < 0:
        return False
    for at in range(0, m, 16):
        near = ((1 << min(n, at + 16 + ahead)) - 1) >> max(0, at - skip) << max(0, at - skip)
        for ch in x[at : at + 16]:
            u = s & get(ch, 0) & near
            if u:
                s = ((s + u) | (s - u)) & full
        matched = n - s.bit_count()
        if matched + skip < min(at + 16, m):
            return False
    return matched >= least


class Lines:
    """The right side: its lines, their counts, and the least ratio."""

    def __init__(self, lines: list[str], least: float, junk: bool):
        self.lines, self.least, self.junk = lines, least, junk
        self.size, self.letters, self.pairs = counts(lines)
        # shared runs of ``width`` characters are at least rate * (m + n) - off
        triple = 2.5 * least - 2 >= 0.05
        self.width, self.rate, self.off = (3, 2.5 * least - 2, 2) if triple else (2, 1.5 * least - 1, 1)
        low, _ = self.span(self.size)
        self.indexed = self.rate * (self.size + low) - self.off > 1
        owner, gram = grams(lines, self.width)
        keep = self.indexed[owner]
        key = np.unique(gram[keep] * len(lines) + owner[keep]) if keep.any() else np.zeros(0, np.int64)
        self.holder = key % max(1, len(lines))
        self.start = np.searchsorted(key // max(1, len(lines)), np.arange(GRAM_BINS + 1))
        self.masks: list[dict[str, int]] = []
        for line in lines:
            places: dict[str, int] = {}
            for k, ch in enumerate(line):
                places[ch] = places.get(ch, 0) | 1 << k
            self.masks.append(places)

    def span(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest lengths that a line of this length can be paired with."""
        return np.ceil(size * self.least / (2 - self.least) - SLACK).astype(np.int64), np.floor(size * (2 - self.least) / self.least + SLACK).astype(np.int64)

    def spans(self) -> tuple[int, int]:
        low, high = self.span(self.size)
        return int(low.min()), int(high.max())

    def candidates(self, lines: list[str], size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(left, right) places of the pairs whose lengths and shared runs allow the ratio."""
        n = len(self.lines)
        low, high = self.span(self.size)
        step = max(1, CELLS // max(1, n))
        for lo in range(0, len(lines), step):
            part, own = lines[lo : lo + step], size[lo : lo + step, None]
            fits = (own >= low) & (own <= high)
            owner, gram = grams(part, self.width)
            for at in range(0, max(1, len(gram)), CELLS // 8):  # as many runs at once as memory allows
                o, g = owner[at : at + CELLS // 8], gram[at : at + CELLS // 8]
                times = self.start[g + 1] - self.start[g]
                total = int(times.sum())
                if at == 0:
                    shared = np.zeros(len(part) * n, np.int64)
                if total:
                    place = np.arange(total) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.start[g], times)
                    shared += np.bincount(np.repeat(o, times) * n + self.holder[place], minlength=len(shared))
            enough = shared.reshape(len(part), n) >= self.rate * (own + self.size) - self.off - SLACK
            left, right = np.nonzero(fits & (enough | ~self.indexed))
            yield left + lo, right

    def pairs_with(self, lines: list[str]) -> Iterator[tuple[int, int, float]]:
        """(place in ``lines``, place in the right side, ratio)."""
        size, letters, pairs = counts(lines)
        for left, right in self.candidates(lines, size):
            for lo in range(0, len(left), 1 << 14):
                i, j = left[lo : lo + (1 << 14)], right[lo : lo + (1 << 14)]
                both = size[i] + self.size[j]
                need = self.least * both / 2 - SLACK
                ok = np.minimum(letters[i], self.letters[j]).sum(1, dtype=np.int32) >= need
                i, j, both, need = i[ok], j[ok], both[ok], need[ok]
                ok = np.minimum(pairs[i], self.pairs[j]).sum(1, dtype=np.int32) >= 3 * need - both - 1
                for a, b, least in zip(i[ok].tolist(), j[ok].tolist(), need[ok].tolist()):
                    x, y = lines[a], self.lines[b]
                    if common(x, self.masks[b], len(y), math.ceil(least)):
                        ratio = SequenceMatcher(None, x, y, autojunk=self.junk).ratio()
                        if ratio >= self.least:
                            yield a, b, ratio


def scan(shared):
    """Batches of (a, x) to batches of (a, place in the right side, ratio); equal lines of a batch are compared once."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = shared.value
        for batch in batches:
            places: dict[str, list[int]] = {}
            for k, x in enumerate(batch.column(1).to_pylist()):
                places.setdefault(x, []).append(k)
            lines = list(places)
            hits = [(k, j, r) for i, j, r in right.pairs_with(lines) for k in places[lines[i]]]
            rows, js, ratios = zip(*hits) if hits else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(js, pa.int32()), pa.array(ratios, pa.float64())], ["a", "_j", "ratio"])

    return apply
