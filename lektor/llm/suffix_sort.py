"""Deep-shallow sorting of byte strings within groups.

Shallow: multikey quicksort over the alphabet of eight-byte words; all groups are split at once, and only the parts that are still equal move
on to the next word. Deep: what is equal to ``SHALLOW`` bytes is ordered by blind tries, which hold nothing but branching positions; a string
walks down by its bytes at those positions to some leaf, is compared with that leaf once, and is hung in where the two part.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 24
_END = -1


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class BlindTrie:
    """Inner nodes are [depth, {byte at depth, or _END: child}], leaves lists of equal strings' numbers."""

    def __init__(self) -> None:
        self.root = None
        self.texts: dict[int, bytes] = {}

    def add(self, number: int, text: bytes) -> None:
        self.texts[number] = text
        leaf = (number,)
        if self.root is None:
            self.root = [leaf]
            return
        node = self.root[0]
        while isinstance(node, list):  # blind: bytes between branching positions are skipped
            at = node[0]
            key = text[at] if at < len(text) else _END
            node = node[1].get(key) or next(iter(node[1].values()))
        other = self.texts[node[0]]
        depth = common(text, other)
        if depth == len(text) == len(other):
            self._replace(other, node + (number,))
            return
        mine = text[depth] if depth < len(text) else _END
        theirs = other[depth] if depth < len(other) else _END
        holder, key = self.root, 0
        node = self.root[0]
        while isinstance(node, list) and node[0] < depth:
            holder, key = node[1], text[node[0]] if node[0] < len(text) else _END
            node = holder[key]
        if isinstance(node, list) and node[0] == depth:
            node[1][mine] = leaf
        else:
            holder[key] = [depth, {theirs: node, mine: leaf}]

    def _replace(self, text: bytes, leaf: tuple) -> None:
        holder, key, node = self.root, 0, self.root[0]
        while isinstance(node, list):
            holder, key = node[1], text[node[0]] if node[0] < len(text) else _END
            node = holder[key]
        holder[key] = leaf

    def order(self) -> list[int]:
        out, stack = [], [self.root[0]] if self.root else []
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
            else:
                out.extend(node)
        return out


def sort(table: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """An order of the rows of ``table`` (bytes, zero behind ``length``) by (group, string)."""
    n, width = table.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = table
    words = padded.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    key = group[order].astype(np.int64)
    part = np.cumsum(np.append(False, key[1:] != key[:-1])) if n else np.zeros(0, np.int64)
    live = np.arange(n)
    for w in range(min(SHALLOW // 8, words.shape[1])):
        size = np.bincount(part[live], minlength=int(part[-1]) + 1 if n else 0)
        live = live[size[part[live]] > 1]
        if not len(live):
            break
        rows = order[live]
        left = np.clip(length[rows] - 8 * w, 0, 8)
        by = np.lexsort((left, words[rows, w], part[live]))
        rows, left = rows[by], left[by]
        order[live] = rows
        word, own = words[rows, w], part[live]
        split = np.zeros(n, np.int64)
        split[live[1:]] = (own[1:] == own[:-1]) & ((word[1:] != word[:-1]) | (left[1:] != left[:-1]))
        part = part + np.cumsum(split)
    # deep: parts that are equal so far
    if n:
        start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        stop = np.append(start[1:], n)
        for a, b in zip(start[stop - start > 1].tolist(), stop[stop - start > 1].tolist()):
            if length[order[a]] <= SHALLOW and length[order[b - 1]] <= SHALLOW:
                continue
            trie = BlindTrie()
            for r in order[a:b].tolist():
                trie.add(r, table[r, SHALLOW : length[r]].tobytes())
            order[a:b] = trie.order()
    return order


def neighbours_common(table: np.ndarray, length: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of an order the common prefix with the place before it (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 1 << 14):
        hi = min(len(order), lo + (1 << 14))
        a, b = order[lo - 1 : hi - 1], order[lo:hi]
        differ = table[a] != table[b]
        first = np.where(differ.any(1), differ.argmax(1), table.shape[1])
        out[lo:hi] = np.minimum(first, np.minimum(length[a], length[b]))
    return out
