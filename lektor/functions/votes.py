"""The row of a block that shares the most words with a set of words, and how many rows share as many.

A block counts for all its rows at once: words of many rows add their row of a bit table, other words add one at each of their places. So a set
costs a few passes over the block's counts however many pairs its common words make, and no pair is written anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

COMMON = 8  # a word of one in so many rows has a row of the table


class Block:
    """Rows with their words; a word that a row repeats counts once."""

    def __init__(self, sets: list[pa.Array]):
        flat, size = pa.chunked_array([s.flatten() for s in sets]), np.concatenate([pc.list_value_length(s).to_numpy(zero_copy_only=False) for s in sets])
        coded = flat.combine_chunks().dictionary_encode()
        word, owner = coded.indices.to_numpy(), np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.n, self.words = len(size), coded.dictionary
        rows = np.bincount(word, minlength=len(self.words))
        self.ends, self.rows = np.append(0, np.cumsum(rows)), owner[np.argsort(word, kind="stable").astype(np.int32)]
        common = np.flatnonzero(rows * COMMON >= self.n)
        self.place = np.full(len(self.words), -1)
        self.place[common] = np.arange(len(common))
        self.table = np.zeros((len(common), self.n), np.uint8)
        for k, w in enumerate(common.tolist()):
            self.table[k, self.rows[self.ends[w] : self.ends[w + 1]]] = 1

    def best(self, words: np.ndarray) -> tuple[int, int, int]:
        """(most words that a row shares, rows that share as many, the first of them) for a set of the block's words."""
        kind = np.uint8 if len(words) < 256 else np.uint32
        count, place = np.zeros(self.n, kind), self.place[words]
        for k in place[place >= 0].tolist():
            count += self.table[k]
        for w in words[place < 0].tolist():
            count[self.rows[self.ends[w] : self.ends[w + 1]]] += 1  # once a row, however often it stands there
        row = int(count.argmax())
        return int(count[row]), int(np.count_nonzero(count == count[row])), row

    def all_best(self, sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(places of the sets that share a word with a row, their ``best``)."""
        size = pc.list_value_length(sets).to_numpy(zero_copy_only=False)
        word = pc.fill_null(pc.index_in(sets.flatten(), value_set=self.words), -1).to_numpy()
        kept = np.append(0, np.cumsum(np.bincount(np.repeat(np.arange(len(size)), size), weights=word >= 0, minlength=len(size)))).astype(int)
        word, known, at, found = word[word >= 0], {}, [], []
        for k, (lo, hi) in enumerate(zip(kept[:-1].tolist(), kept[1:].tolist())):
            if lo < hi:
                own = word[lo:hi]
                if (key := own.tobytes()) not in known:
                    known[key] = self.best(own)
                at.append(k)
                found.append(known[key])
        return np.array(at, np.int64), np.array(found, np.int64).reshape(-1, 3)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (cell, kind, left, right, words), sorted by cell and kind, to batches of (left, right, ties, shared).

    Rows of kind 0 are a cell's block, the sets of kind 1 are asked of it. Equal sets of a batch are asked once.
    """
    cell, held, block, names = None, [], None, None
    for batch in batches:
        cells, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = (np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(cells)]):
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            if cells[lo] != cell:
                cell, held, block = cells[lo], [], None
            if kinds[lo] == 0:
                held.append(part)
                continue
            if held:
                block, names = Block([p.column(4) for p in held]), pa.concat_arrays([p.column(3) for p in held])
                held = []
            if block is not None:
                at, found = block.all_best(part.column(4))
                columns = [part.column(2).take(pa.array(at)), names.take(pa.array(found[:, 2])), pa.array(found[:, 1]), pa.array(found[:, 0])]
                yield pa.RecordBatch.from_arrays(columns, ["_l", "_r", "ties", "shared"])
