"""Suffix-array dedup: every byte covered by a string of SPAN bytes that also starts anywhere else is removed.

1. Anchors. Of the GRAM-byte grams in a window of SPAN bytes those with the least hash are its anchors. Equal windows have equal anchors at
   equal places, so an anchor hash that occurs once proves all its windows unique. Hashes go by range, packed and without repeats of a
   text within a task, to be counted; the repeated ones return to their texts.
2. Contexts. A repeated anchor's context is what a window around it can reach: SPAN - GRAM bytes on either side. Contexts are sent by
   anchor, each distinct one once a task; which anchors have them stays in a table. An anchor that ``HOT`` texts or more hold is split: two contexts that
   are equal in SPAN bytes agree, on top of the gram, in one of ``PARTS`` stretches of SIDE * 3 / 4 bytes around it, so its contexts go
   by those stretches and no task sees all of them.
3. Sorting. The contexts of an anchor are sorted to the right, and reversed to the left, by deep-shallow sorting (``suffix_sort``): a sparse
   suffix array around the anchors. The classes of contexts that agree on l bytes to the left are ranges of the left order; in each, the
   neighbours in the right order agree longest, on r bytes. Where GRAM + l + r reaches SPAN, that stretch occurs elsewhere, and windows have
   no other way to be equal, so the stretches cover exactly the bytes to remove.
4. Stretches join the anchors that have their context and are merged per text.

Texts are handled once however often they occur: a text of SPAN bytes or more that occurs twice is removed whole, and one copy takes part for
the others' sake. Matches are judged on the input and never cross texts. A partition is worked through in pieces whose number grows with the
input, so memory does not; anchors and texts of a piece are streamed. Grams are known by 64-bit hashes; what surrounds them is compared byte by byte.

Defined results: a null text is empty; texts shorter than SPAN lose nothing; repeated rows are copies; an empty table gives an empty result;
other columns are ignored by ``spans`` and kept by ``remove``. Where removal cuts a character, ``remove`` drops the rest of it, so the text stays
valid UTF-8, while the digest is over the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lektor.llm import bytetext as bt
from lektor.llm import packing, suffix_sort, tables

SPAN, GRAM, FLUSH, HOT = 200, 100, 1 << 19, 1024
SIDE = SPAN - GRAM
PARTS = [(SIDE * k // 4, SIDE * (3 - k) // 4) for k in range(3, -1, -1)]  # bytes to the left and right of the gram
ANCHOR_PIECE, CONTEXT_PIECE, SLICE = 64 << 20, 8 << 20, 4096  # bytes of text behind a piece of a partition; anchors handled at once
U = np.uint64
_MOST = U(2**64 - 1)
_SCHEMA = pa.schema([("slot", pa.int32()), ("blob", pa.binary())])


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over values[i : i + width], for every i where that fits."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def anchors(block: bt.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, position in the block, hash) of all anchors of a block. The hash is mixed once more: those of anchors alone are all small."""
    data, offsets = block.data, block.offsets
    n = len(data)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n < SPAN:
        return none
    sums = bt.prefix_sums(data)
    _, inverse = bt.powers(n)
    with np.errstate(over="ignore"):
        hashed = bt.mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    room = np.zeros(n + 1, np.int32)  # bytes from a position to the end of its document
    size = np.diff(offsets)
    room[:n] = np.repeat(offsets[1:], size) - np.arange(n)
    hashed[room[: len(hashed)] < GRAM] = _MOST
    least = _sliding(hashed, SPAN - GRAM + 1, np.minimum)
    least = np.where(room[: len(least)] >= SPAN, least, U(0))
    padded = np.concatenate([np.zeros(SPAN - GRAM, np.uint64), least, np.zeros(len(hashed) - len(least), np.uint64)])
    most = _sliding(padded, SPAN - GRAM + 1, np.maximum)[: len(hashed)]
    at = np.flatnonzero((most >= hashed) & (hashed != _MOST))
    return np.searchsorted(offsets, at, "right") - 1, at, bt.mix(hashed[at] + U(1))


def _long(docs: DataFrame) -> DataFrame:
    return docs.where(F.octet_length("text") >= SPAN).select("t", "text")


def _new(keys: list, seen: set) -> np.ndarray:
    """Which keys are seen for the first time."""
    out = np.zeros(len(keys), bool)
    for i, t in enumerate(keys):
        if t not in seen:
            seen.add(t)
            out[i] = True
    return out


def _once(docs: DataFrame) -> DataFrame:
    """(t, text) of the texts long enough, each at most once a task."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = _new(batch.column(0).to_pylist(), seen)
            if fresh.any():
                yield batch if fresh.all() else batch.filter(pa.array(fresh))

    return _long(docs).mapInArrow(apply, "t long, text string")


def texts(docs: DataFrame) -> DataFrame:
    """``docs`` with text (null: empty), its digest and a key t of 60 bits of that."""
    rows = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("sha", F.sha2("text", 256))
    return rows.withColumn("t", F.conv(F.substring("sha", 1, 15), 16, 10).cast("long"))


def _send(rows: DataFrame, n_slots: int) -> DataFrame:
    """(slot, blob): anchor hashes by range, with their text and whether they repeat in it."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            t, token, again = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(token, kind="stable")
            t, token, again = t[order], token[order], again[order]
            edges = np.searchsorted(packing.slots(token, n_slots), np.arange(n_slots + 1))
            for s in np.flatnonzero(np.diff(edges)).tolist():
                lo, hi = edges[s], edges[s + 1]
                own, index = np.unique(t[lo:hi], return_inverse=True)
                yield pa.RecordBatch.from_pydict({"slot": [s], "blob": [packing.pack(own, index.astype(np.uint32), packing.deltas(token[lo:hi]), again[lo:hi])]}, schema=_SCHEMA)
            held, size = [], 0

        for batch in batches:
            keys = batch.column(0).to_numpy()
            fresh = _new(keys.tolist(), seen)
            for block in bt.blocks(batch.column(1)):
                if not fresh[block.lo : block.hi].any():
                    continue
                doc, _, hashed = anchors(block)
                first = fresh[block.lo + doc]
                doc, token = doc[first], hashed[first] >> U(16)
                order = np.lexsort((token, doc))
                doc, token = doc[order], token[order]
                new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (token[1:] != token[:-1]))) if len(doc) else np.zeros(0, int)
                again = (np.diff(np.append(new, len(doc))) > 1).astype(np.uint8)
                held.append((keys[block.lo + doc[new]], token[new], again))
                size += len(new)
                if size >= FLUSH:
                    yield from flush()
        if size:
            yield from flush()

    return rows.mapInArrow(apply, "slot int, blob binary")


def _repeated(sent: DataFrame, n_slots: int, hot_size: int = HOT) -> DataFrame:
    """(slot, blob): anchors that occur twice or more, by range of their texts' keys, and whether they are hot."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in packing.groups(batches):
            parts = []
            for b in rows:
                for blob in b.column(1):
                    own, index, delta, again = packing.unpack(blob.as_buffer(), "<i8", "<u4", "<u8", "u1")
                    parts.append((own[index], np.cumsum(delta, dtype=np.uint64), again))
            t, token, again = (np.concatenate(x) for x in zip(*parts))
            del parts
            order = np.lexsort((t, token))
            t, token, again = t[order], token[order], again[order]
            start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            size = np.diff(np.append(start, len(token)))
            many = (np.maximum.reduceat(t, start) != np.minimum.reduceat(t, start)) | (np.maximum.reduceat(again, start) > 0)
            use = np.repeat(many, size)
            t, token, hot = t[use], token[use], np.repeat(size >= hot_size, size)[use].astype(np.uint8)
            order = np.argsort(t, kind="stable")
            t, token, hot = t[order], token[order], hot[order]
            edges = np.searchsorted(_slot_of(t, n_slots), np.arange(n_slots + 1))
            for s in np.flatnonzero(np.diff(edges)).tolist():
                lo, hi = edges[s], edges[s + 1]
                yield pa.RecordBatch.from_pydict({"slot": [s], "blob": [packing.pack(packing.deltas(t[lo:hi]), token[lo:hi], hot[lo:hi])]}, schema=_SCHEMA)

    return sent.mapInArrow(apply, "slot int, blob binary")


def _slot_of(t: np.ndarray, n: int) -> np.ndarray:
    return ((t >> 28) * n) >> 32


def _slot_column(n: int) -> F.Column:
    return F.shiftright(F.shiftright("t", 28) * n, 32).cast("int")


def _dealt(rows: DataFrame, width: int, pieces: int, *order: str) -> DataFrame:
    """Rows by range of their slot, of which a partition has ``pieces``, in the order of slots."""
    return rows.repartitionById(width, (F.col("slot") / pieces).cast("int")).sortWithinPartitions("slot", *order)


_OUT = "kind int, slot int, t long, text string, blob binary, c array<long>, pos array<int>"


def _contexts(rows: DataFrame, repeated: DataFrame, width: int, pieces: int, context_slots: int) -> DataFrame:
    """A table of three kinds of rows: texts with repeated anchors (1), blobs of contexts by anchor (2), and the anchors' contexts and positions (3)."""
    none = lambda kind: F.lit(None).cast(kind)
    left = repeated.select("slot", F.lit(0).alias("kind"), none("long").alias("t"), none("string").alias("text"), "blob")
    right = rows.select(_slot_column(width * pieces).alias("slot"), F.lit(1).alias("kind"), "t", "text", none("binary").alias("blob"))
    both = _dealt(left.unionByName(right), width, pieces, "kind", "t")
    schema = pa.schema([("kind", pa.int32()), ("slot", pa.int32()), ("t", pa.int64()), ("text", pa.string()), ("blob", pa.binary()), ("c", pa.list_(pa.int64())), ("pos", pa.list_(pa.int32()))])

    def row(kind, slot=None, t=None, text=None, blob=None, c=None, pos=None) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": [kind], "slot": [slot], "t": [t], "text": [text], "blob": [blob], "c": [c], "pos": [pos]}, schema=schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            h, c, l, r, count, body = (np.concatenate(x) for x in zip(*held))
            held, size = [], 0
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
            count = np.minimum(np.add.reduceat(count[order].astype(np.int64), first), 2).astype(np.uint8)
            keep = order[first]
            h, c, l, r, body = h[first], c[first], l[keep], r[keep], body[keep]
            edges = np.searchsorted(packing.slots(h >> U(16), context_slots), np.arange(context_slots + 1))
            for s in np.flatnonzero(np.diff(edges)).tolist():
                lo, hi = edges[s], edges[s + 1]
                yield row(2, slot=s, blob=packing.pack(h[lo:hi], c[lo:hi], l[lo:hi], r[lo:hi], count[lo:hi]) + body[lo:hi].tobytes())

        def hold(data: np.ndarray, h: np.ndarray, c: np.ndarray, at: np.ndarray, l: np.ndarray, r: np.ndarray) -> None:
            """Keep the distinct contexts."""
            nonlocal size
            order = np.lexsort((c, h))
            new = np.flatnonzero(np.append(True, (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])))
            count = np.minimum(np.diff(np.append(new, len(h))), 2).astype(np.uint8)
            keep = order[new]
            reach = np.arange(SIDE, dtype=np.int32)
            for lo in range(0, len(keep), SLICE):
                k = keep[lo : lo + SLICE]
                a, left, right = at[k].astype(np.int32)[:, None], l[k][:, None], r[k][:, None]
                before = np.where(reach < left, data[np.maximum(a - 1 - reach, 0)], np.uint8(0))
                after = np.where(reach < right, data[np.minimum(a + GRAM + reach, len(data) - 1)], np.uint8(0))
                held.append((h[k], c[k], l[k].astype(np.uint8), r[k].astype(np.uint8), count[lo : lo + SLICE], np.concatenate([before, after], axis=1)))
                size += len(k)

        wanted: list[np.ndarray] = []
        lookup = hot = last = None
        for slot, batch, new in packing.runs(batches):
            if new:
                wanted, hot_tokens, lookup, last = [], [], None, None
            kinds = batch.column(1).to_numpy()
            split = int(np.searchsorted(kinds, 1))
            for blob in batch.column(4).slice(0, split):
                delta, token, many = packing.unpack(blob.as_buffer(), "<i8", "<u8", "u1")
                wanted.append(bt.mix(np.cumsum(delta).view(np.uint64) * U(0x9E3779B97F4A7C15) ^ token))
                hot_tokens.append(np.unique(token[many > 0]))
            if split == batch.num_rows or not wanted:
                continue
            if lookup is None:
                lookup, hot = np.unique(np.concatenate(wanted)), np.unique(np.concatenate(hot_tokens))
                wanted, hot_tokens = [lookup], [hot]
            keys = batch.column(2).slice(split).to_numpy()
            fresh = np.append(last is None or keys[0] != last, keys[1:] != keys[:-1])
            last = keys[-1]
            texts_ = batch.column(3).slice(split).filter(pa.array(fresh))
            keys = keys[fresh]
            for block in bt.blocks(texts_):
                doc, at, hashed = anchors(block)
                if not len(doc):
                    continue
                own = keys[block.lo + doc]
                with np.errstate(over="ignore"):
                    probe = bt.mix(own.view(np.uint64) * U(0x9E3779B97F4A7C15) ^ (hashed >> U(16)))
                hit = lookup[np.minimum(np.searchsorted(lookup, probe), len(lookup) - 1)] == probe
                doc, at, hashed, own = doc[hit], at[hit], hashed[hit], own[hit]
                if not len(doc):
                    continue
                lo, hi = block.offsets[doc], block.offsets[doc + 1]
                l, r = np.minimum(SIDE, at - lo), np.minimum(SIDE, hi - at - GRAM)
                sums = bt.prefix_sums(block.data)
                with np.errstate(over="ignore"):
                    c = bt.mix(bt.span_hashes(sums, at - l, at + GRAM + r) + bt.mix(l.astype(np.uint64) * U(128) + r.astype(np.uint64)))
                spread = np.isin(hashed >> U(16), hot) if len(hot) else np.zeros(len(doc), bool)
                sent = [(hashed[~spread], np.flatnonzero(~spread))]
                for k, (left, right) in enumerate(PARTS if spread.any() else []):
                    where = np.flatnonzero(spread & (l >= left) & (r >= right))
                    sent.append((bt.mix(bt.span_hashes(sums, at[where] - left, at[where] + GRAM + right) ^ U(k + 1)), where))
                for h, where in sent:
                    if len(h):
                        hold(block.data, h, c[where], at[where], l[where], r[where])
                    if size >= FLUSH // 16:
                        yield from flush()
                for d in np.unique(doc).tolist():
                    a, b = np.searchsorted(doc, [d, d + 1])
                    yield row(1, t=int(own[a]), text=texts_[block.lo + d].as_py())
                    yield row(3, t=int(own[a]), c=c[a:b].view(np.int64), pos=(at[a:b] - lo[a]).astype(np.int32))
        if size:
            yield from flush()

    return both.mapInArrow(apply, _OUT)


def stretches(h: np.ndarray, c: np.ndarray, l: np.ndarray, r: np.ndarray, count: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, bytes to the left, bytes to the right of the gram) that occur elsewhere, from distinct contexts grouped by anchor hash h (ascending).

    Every stretch of a context holds the anchor's gram, so their union is one stretch: the farthest left and the farthest right of them.
    """
    l, r = l.astype(np.int64), r.astype(np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    whole = (count > 1) & (l + r >= SIDE)
    out.append((c[whole], l[whole], r[whole]))
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(start, len(h)))
    alone = np.repeat(size == 1, size)
    keep = ~alone
    c, l, r, body = c[keep], l[keep], r[keep], body[keep]
    group = np.repeat(np.arange(int((size > 1).sum())), size[size > 1])
    if not len(group):
        return _widest(out)
    before, after = np.ascontiguousarray(body[:, :SIDE]), np.ascontiguousarray(body[:, SIDE:])
    left = suffix_sort.sort(before, l, group)
    left_common = suffix_sort.neighbours_common(before, l, left)
    right = suffix_sort.sort(after, r, group)
    right_common = suffix_sort.neighbours_common(after, r, right)
    size = size[size > 1]
    start = np.cumsum(size) - size
    # two contexts: one comparison each way
    two = start[size == 2]
    x, y = left_common[two + 1], right_common[two + 1]
    ok = x + y >= SIDE
    for member in (two[ok], two[ok] + 1):
        out.append((c[member], x[ok], y[ok]))
    rank = np.empty(len(group), np.int64)
    rank[right] = np.arange(len(group))
    found: list[tuple] = []
    for a, m in zip(start[size > 2].tolist(), size[size > 2].tolist()):
        lows = left_common[a + 1 : a + m].tolist()
        ranks = rank[left[a : a + m]] - a
        least = _minima(right_common[a : a + m])
        stack = [(0, 0)]  # (common bytes, first place): ranges of the left order that agree on ever more bytes
        for i, low in enumerate(lows + [-1], 1):
            first = i - 1
            while stack and stack[-1][0] > low:
                depth, first = stack.pop()
                own = np.sort(ranks[first:i])
                near = _least_between(least, own[:-1] + 1, own[1:])
                best = np.maximum(np.append(-1, near), np.append(near, -1))
                hit = np.flatnonzero(best >= SIDE - depth)
                if len(hit):
                    found.append((c[right[a + own[hit]]], np.full(len(hit), depth), best[hit]))
            if low >= 0 and (not stack or stack[-1][0] < low):
                stack.append((low, first))
    return _widest(out + found)


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """Minima of every 1, 2, 4, ... neighbours."""
    out, width = [values.astype(np.int16)], 1
    while 2 * width <= len(values):
        out.append(np.minimum(out[-1][:-width], out[-1][width:]))
        width *= 2
    return out


def _least_between(minima: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least value from each lo to hi, both included."""
    level = np.frexp(hi - lo + 1)[1] - 1
    out = np.empty(len(lo), np.int64)
    for k in np.unique(level).tolist():
        at = level == k
        out[at] = np.minimum(minima[k][lo[at]], minima[k][hi[at] + 1 - (1 << k)])
    return out


def _widest(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c, l, r = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(c, kind="stable")
    c, l, r = c[order], l[order], r[order]
    start = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
    return (c[start], np.maximum.reduceat(l, start), np.maximum.reduceat(r, start)) if len(c) else (c, l, r)


def _resolve(blobs: DataFrame) -> DataFrame:
    """(c, l, r): of each context the stretches that occur elsewhere."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in packing.groups(batches):
            parts = []
            for b in rows:
                for blob in b.column(1):
                    raw = blob.as_buffer()
                    h, c, l, r, count = packing.unpack(raw, "<u8", "<u8", "u1", "u1", "u1")
                    body = np.frombuffer(raw, np.uint8)[len(raw) - 2 * SIDE * len(h) :].reshape(-1, 2 * SIDE)
                    parts.append((h, c, l, r, count, body))
            h, c, l, r, count = (np.concatenate([p[k] for p in parts]) for k in range(5))
            order = np.lexsort((c, h))
            new = np.flatnonzero(np.append(True, (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])))
            count = np.add.reduceat(count[order].astype(np.int64), new)
            keep = order[new]
            body = np.concatenate([p[5] for p in parts])[keep]
            del parts
            got_c, got_l, got_r = stretches(h[keep], c[keep], l[keep], r[keep], count, body)
            yield pa.RecordBatch.from_arrays([pa.array(got_c.view(np.int64)), pa.array(got_l.astype(np.int32)), pa.array(got_r.astype(np.int32))], ["c", "l", "r"])

    return blobs.mapInArrow(apply, "c long, l int, r int")


def _cut(found: DataFrame, spans: DataFrame, n_slots: int, with_text: bool) -> DataFrame:
    """(t, n_removed, n_spans, kept_sha256[, kept]) of the texts that lose bytes."""
    rows = found.where("kind = 1").select("t", F.lit(1).alias("kind"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), "text")
    marks = spans.select("t", F.lit(0).alias("kind"), "lo", "hi", F.lit(None).cast("string").alias("text"))
    both = rows.unionByName(marks).withColumn("slot", _slot_column(n_slots)).repartitionById(n_slots, F.col("slot")).sortWithinPartitions("t", "kind").drop("slot")
    fields = [("t", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * with_text
    schema = pa.schema(fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in fields]
        size = 0
        for t, parts in packing.groups(batches):
            lo = np.concatenate([b.column(2).to_numpy() for b in parts])[:-1]
            hi = np.concatenate([b.column(3).to_numpy() for b in parts])[:-1]
            if not len(lo):
                continue
            text = parts[-1].column(4)[-1].as_py().encode()
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], np.maximum.accumulate(hi[order])
            cut = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
            lo, hi = lo[cut], hi[np.append(cut[1:] - 1, len(hi) - 1)]
            kept = b"".join(text[a:b] for a, b in zip(np.append(0, hi).tolist(), np.append(lo, len(text)).tolist()))
            values = [int(t), int((hi - lo).sum()), len(lo), hashlib.sha256(kept).hexdigest()] + [kept.decode("utf-8", "ignore")] * with_text
            for column, v in zip(out, values):
                column.append(v)
            size += len(kept) + 200
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(x, f[1]) for x, f in zip(out, fields)], schema=schema)
                out, size = [[] for _ in fields], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, f[1]) for x, f in zip(out, fields)], schema=schema)

    return both.mapInArrow(apply, "t long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text)


def losses(keyed: DataFrame, with_text: bool, n_bytes: int, hot: int = HOT) -> DataFrame:
    """What each text loses, from ``texts``: (t, n_removed, n_spans, kept_sha256[, kept]) of those that lose anything while occurring once.
    ``n_bytes`` is the size of all texts, which sets the number of pieces."""
    width = tables.width(keyed.sparkSession)
    few, many = (max(1, -(-n_bytes // (width * size))) for size in (ANCHOR_PIECE, CONTEXT_PIECE))
    repeated = _repeated(_dealt(_send(_long(keyed), width * few), width, few), width * few, hot)
    found = tables.materialize(_contexts(_once(keyed), repeated, width, few, width * many), "repeat-contexts")
    blobs = _dealt(found.where("kind = 2").select("slot", "blob"), width, many)
    places = found.where("kind = 3").select("t", F.explode(F.arrays_zip("c", "pos")).alias("p")).select("t", "p.c", "p.pos")
    # a split anchor's contexts come back once a part; as a table of their own they leave the join free to deal a frequent context's places to many tasks
    widest = tables.materialize(_resolve(blobs).groupBy("c").agg(F.max("l").alias("l"), F.max("r").alias("r")), "repeat-found")
    spans = places.join(widest, "c").select("t", (F.col("pos") - F.col("l")).alias("lo"), (F.col("pos") + GRAM + F.col("r")).alias("hi"))
    return _cut(found, spans, width, with_text)


EMPTY = hashlib.sha256(b"").hexdigest()


def spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document. Anchors in ``hot`` texts or more are split."""
    keyed = texts(docs)
    own = tables.materialize(keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "sha", "t"), "repeat-texts")
    lost = losses(keyed, False, own.agg(F.sum("n_bytes")).first()[0] or 0, hot)
    copies = own.where(F.col("n_bytes") >= SPAN).groupBy("sha", "t").agg(F.count(F.lit(1)).alias("copies"))
    fate = copies.join(lost, "t", "left")
    whole = F.col("copies") > 1
    out = own.join(fate, ["sha", "t"], "left")
    return out.select("doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(whole, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def remove(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated stretches taken out of the texts (and n_chars, where there is such a column, counted anew)."""
    rest = [c for c in docs.columns if c != "text"]
    keyed = texts(docs.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("_")).alias("row"), "text"))  # other columns keep out of the way
    lost = losses(keyed, True, docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0).select("t", "kept")
    copies = keyed.where(F.octet_length("text") >= SPAN).groupBy("t").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    fate = copies.join(lost, "t", "full")
    out = keyed.join(fate, "t", "left").withColumn("text", F.when(F.col("copies") > 1, F.lit("")).otherwise(F.coalesce("kept", "text")))
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[own[c].alias(c) if c in own else F.col(f"row.`{c}`") for c in docs.columns])


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(tables.read(spark, sf_dir, "documents").select("doc_id", "text"))
