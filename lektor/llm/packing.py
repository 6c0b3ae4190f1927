"""Postings as binary blobs: arrays split into byte planes, which the shuffle's compression then shrinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any integer type; each with its length, then its bytes plane by plane."""
    out = []
    for a in arrays:
        out.append(np.array([len(a), a.dtype.itemsize], "<i4").tobytes())
        out.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return b"".join(out)


def unpack(blob, *kinds: str) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(blob, np.uint8), 0, []
    for kind in kinds:
        n, size = raw[at : at + 8].view("<i4")
        at += 8
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).reshape(-1).view(kind))
        at += n * size
    return out


def deltas(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def slots(values48: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of 48-bit values each falls into; keeps their order."""
    return (((values48 >> np.uint64(16)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def groups(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Runs of rows with the same value of a sorted integer column, across batches."""
    held, now = [], None
    for batch in batches:
        key = batch.column(column).to_numpy()
        if not len(key):
            continue
        cuts = np.flatnonzero(np.diff(key)) + 1
        for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(key))):
            if held and key[lo] != now:
                yield now, held
                held = []
            now = key[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, held


def runs(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[int, pa.RecordBatch, bool]]:
    """(value, rows, whether they are the first) for runs of the same value of a sorted integer column, batch by batch."""
    now = None
    for batch in batches:
        key = batch.column(column).to_numpy()
        if not len(key):
            continue
        cuts = np.flatnonzero(np.diff(key)) + 1
        for lo, hi in zip(np.append(0, cuts).tolist(), np.append(cuts, len(key)).tolist()):
            yield int(key[lo]), batch.slice(lo, hi - lo), key[lo] != now
            now = key[lo]
