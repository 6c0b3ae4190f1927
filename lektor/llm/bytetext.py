"""Whole texts as UTF-8 byte arrays: word bounds, hashes and shingles, vectorised over a block of documents.

Texts arrive as Arrow string arrays. Their buffers are viewed as numpy arrays without making Python strings; a block holds about
``BLOCK`` bytes, so the working memory is a small multiple of that (or of the longest text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
U = np.uint64

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n, BLOCK) + 1
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.concatenate([[U(1)], np.full(size, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Block:
    """Documents lo..hi of a batch: their bytes and offsets (one more than documents, from 0)."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets

    def __len__(self) -> int:
        return self.hi - self.lo


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """Cut an Arrow string array into blocks of about ``limit`` bytes; null counts as empty. A document is never cut."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    if not (wide or pa.types.is_string(texts.type)):
        texts, wide = texts.cast(pa.large_string()), True
    _, offs, data = texts.buffers()
    if not len(texts):
        return
    ends = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        yield Block(lo, hi, raw[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo])
        lo = hi


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = _SEPARATOR[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.ones(n + 1, bool)
    before[1:] = gap
    before |= cut
    after = np.ones(n + 1, bool)
    after[:n] = gap
    after |= cut
    starts = np.flatnonzero(~gap & before[:n])
    ends = np.flatnonzero(~gap & after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    power, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_TABLE[data] * power[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    _, inverse = powers(len(sums) - 1)
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_sums(data), starts, ends)


_STEP = [U(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingles as sorted hashes, document after document, with each document's first index.

    A document of fewer words is one shingle, all of its words; one without words has none.
    """
    count = np.diff(first)
    total = len(hashes)
    with np.errstate(over="ignore"):
        acc = np.zeros(max(0, total - width + 1), np.uint64)
        for k in range(width):
            acc += hashes[k : total - width + 1 + k] * _STEP[k % 5] + U(k * k)
        acc = mix(acc)
        doc = np.repeat(np.arange(len(count)), np.maximum(count - width + 1, 0))
        take = np.arange(len(doc)) + (first[:-1] - np.concatenate([[0], np.cumsum(np.maximum(count - width + 1, 0))[:-1]]))[doc] if len(doc) else doc
        acc = acc[take] if len(doc) else np.zeros(0, np.uint64)
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            own = []
            for d in short:
                h = U(0x2545F4914F6CDD1D) * U(int(count[d]))
                for x in hashes[first[d] : first[d + 1]]:
                    h = mix(np.array([h * U(0x9FB21C651E98DF25) + x]))[0]
                own.append(h)
            acc, doc = np.concatenate([acc, np.array(own, np.uint64)]), np.concatenate([doc, short])
    order = np.lexsort((acc, doc))
    acc, doc = acc[order], doc[order]
    if len(acc):
        new = np.ones(len(acc), bool)
        new[1:] = (acc[1:] != acc[:-1]) | (doc[1:] != doc[:-1])
        acc, doc = acc[new], doc[new]
    return acc, np.searchsorted(doc, np.arange(len(count) + 1))
