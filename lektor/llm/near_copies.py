"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when 100 * |x & y| >= 75 * |x | y| for their sets of distinct five-word shingles. Documents of equal sets are one class;
only classes take part in the search.

1. Shingle hashes are sent by hash range, as packed blobs without repeats of a class within a task, and counted: the number of classes that
   hold a shingle is its frequency. Only shingles of two classes or more go back to their classes.
2. All sets are ordered by (frequency, hash). A class of n shingles needs ``need = ceil(0.75 n)`` of them in any partner, so two partners share at least
   l shingles among their first ``n - need + l``. Each class takes the l of least estimated cost: postings scanned plus verifications, whose
   number shrinks as l grows. A pair whose lengths differ is a candidate when it shares the smaller l within the two prefixes: the longer
   prefix contains the shorter one, so no partner is lost. Classes that cannot have a partner at all leave here.
3. Candidates are verified on the full lists of shared shingles (those of frequency one can't be shared, so a pair is no candidate when the
   smaller list falls short of the overlap that the two sizes ask for). To keep groups of near copies from making all their pairs, classes are
   first paired, under the ``SKETCH`` shingles of least hash in each, only with the most central class of the shingle and with the next one in
   that order; what these pairs link becomes components. Then every candidate pair of different components is made and verified, so the
   components are exact while pairs inside a component, whose links cannot change it, are never made. Before a pair is made, histograms of
   the two shared lists over ``BINS`` hash bins bound their overlap from above: the sum of the smaller counts.
4. A shingle of more than ``HOT`` classes is split. Its classes fall into blocks by hash; in the first round each block has its own most
   central class, and those meet in turn; in the second each pair of blocks is a group of its own. A partition is worked through in pieces
   whose number grows with the number of shingles, so memory does not.

Nothing is collected but counts; links and labels are tables in the shared folder. Hashes have 64 bits (48 for shingles on the way),
so results are exact but for collisions.

Defined results: words are runs other than ASCII white space, A-Z lower-cased; a text of fewer than five words is one shingle of all its
words; null, empty and blank texts have no shingle and are linked with nothing; rows without doc_id take no part and return a null
component; repeated rows are equal sets, hence linked; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lektor.llm import bytetext as bt
from lektor.llm import components, packing, tables

WIDTH, PERCENT, MOST_MATCHES, VERIFY_COST, SKETCH, BINS, FLUSH, HOT, PIECE = 5, 75, 8, 8.0, 6, 64, 1 << 21, 512, 4_000_000
U = np.uint64
_SLOTS = pa.schema([("slot", pa.int32()), ("blob", pa.binary())])


def block_sets(block: bt.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, first, key, key2): each document's sorted distinct shingle hashes and a 128-bit hash of the set."""
    data = bt.lowered(block.data)
    starts, ends, first = bt.words(data, block.offsets)
    sh, at = bt.shingles(bt.word_hashes(data, starts, ends), first, WIDTH)
    keys = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        with np.errstate(over="ignore"):
            total = np.append(U(0), np.cumsum(bt.mix(sh ^ U(salt)), dtype=np.uint64))
            keys.append(bt.mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)))
    return sh, at, keys[0], keys[1]


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n, k, k2): size and hash of each document's set; k names its class."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bt.blocks(batch.column(1)):
                _, at, key, key2 = block_sets(block)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, len(block)), pa.array(np.diff(at), pa.int64()), pa.array(key.view(np.int64)), pa.array(key2.view(np.int64))], ["doc_id", "n", "k", "k2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(apply, "doc_id long, n long, k long, k2 long")


def _send(docs: DataFrame, n_slots: int) -> DataFrame:
    """(slot, blob): shingles by hash range, with the class and its size."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            token = np.concatenate([h[0] for h in held])
            key, n = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            owner = np.repeat(np.arange(len(key)), n)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            edges = np.searchsorted(packing.slots(token, n_slots), np.arange(n_slots + 1))
            out: dict[str, list] = {"slot": [], "blob": []}
            for s in np.flatnonzero(np.diff(edges)).tolist():
                lo, hi = edges[s], edges[s + 1]
                own, index = np.unique(owner[lo:hi], return_inverse=True)
                out["slot"].append(s)
                out["blob"].append(packing.pack(key[own], n[own].astype(np.uint32), index.astype(np.uint32), packing.deltas(token[lo:hi])))
                if len(out["slot"]) >= 16:
                    yield pa.RecordBatch.from_pydict(out, schema=_SLOTS)
                    out = {"slot": [], "blob": []}
            if out["slot"]:
                yield pa.RecordBatch.from_pydict(out, schema=_SLOTS)
            held, size = [], 0

        for batch in batches:
            for block in bt.blocks(batch.column(0)):
                sh, at, key, _ = block_sets(block)
                n = np.diff(at)
                fresh = np.zeros(len(n), bool)
                for d, k in enumerate(key.tolist()):
                    if n[d] and k not in seen:
                        seen.add(k)
                        fresh[d] = True
                if fresh.any():
                    held.append((sh[np.repeat(fresh, n)] >> U(16), key[fresh], n[fresh]))
                    size += int(n[fresh].sum())
                if size >= FLUSH:
                    yield from flush()
        if size:
            yield from flush()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(apply, "slot int, blob binary")


def _count(sent: DataFrame, n_slots: int) -> DataFrame:
    """(slot, blob): shingles of two classes or more, by class range, with their frequency."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in packing.groups(batches):
            tokens, keys, sizes = [], [], []
            for b in rows:
                for blob in b.column(1):
                    key, n, index, delta = packing.unpack(blob.as_buffer(), "<u8", "<u4", "<u4", "<u8")
                    tokens.append(np.cumsum(delta, dtype=np.uint64))
                    keys.append(key[index])
                    sizes.append(n[index])
            token, key, n = np.concatenate(tokens), np.concatenate(keys), np.concatenate(sizes)
            del tokens, keys, sizes
            order = np.argsort(token, kind="stable")
            token = token[order]
            twice = np.zeros(len(token), bool)
            twice[1:] = token[1:] == token[:-1]
            twice[:-1] |= twice[1:]
            token, order = token[twice], order[twice]
            key, n = key[order], n[order]
            order = np.lexsort((key, token))
            token, key, n = token[order], key[order], n[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
            token, key, n = token[new], key[new], n[new]
            start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, int)
            df = np.repeat(np.diff(np.append(start, len(token))), np.diff(np.append(start, len(token))))
            many = df > 1
            token, key, n, df = token[many], key[many], n[many], df[many]
            order = np.argsort(key, kind="stable")
            token, key, n, df = token[order], key[order], n[order], df[order]
            edges = np.searchsorted(packing.slots(key >> U(16), n_slots), np.arange(n_slots + 1))
            for s in np.flatnonzero(np.diff(edges)).tolist():
                lo, hi = edges[s], edges[s + 1]
                own, index = np.unique(key[lo:hi], return_inverse=True)
                at = np.searchsorted(key[lo:hi], own)
                blob = packing.pack(own, n[lo:hi][at].astype(np.uint32), index.astype(np.uint32), token[lo:hi], np.minimum(df[lo:hi], 2**32 - 1).astype(np.uint32))
                yield pa.RecordBatch.from_pydict({"slot": [s], "blob": [blob]}, schema=_SLOTS)

    return sent.mapInArrow(apply, "slot int, blob binary")


def need(n):
    return (PERCENT * n + 99) // 100


def prefix(n: int, df: np.ndarray) -> tuple[int, int]:
    """(l, shared shingles in the l-prefix) of least estimated cost for a set of n shingles, of which those of frequency ``df`` (ascending) are shared."""
    least, k = need(n), len(df)
    scanned = np.append(0, np.cumsum(df, dtype=np.float64))
    ls = np.arange(1, max(1, min(MOST_MATCHES, least)) + 1)
    length = np.minimum(k - least + ls, k)
    cost = scanned[length] * (1 + VERIFY_COST / ls)
    best = int(np.argmin(cost))
    return int(ls[best]), int(length[best])


def _bins(tokens: np.ndarray) -> bytes:
    """Histogram over hash bins; all 255 where a count doesn't fit a byte, which bounds nothing."""
    count = np.bincount((bt.mix(tokens + U(1)) % U(BINS)).astype(np.int64), minlength=BINS)
    return (count if count.max() < 255 else np.full(BINS, 255)).astype(np.uint8).tobytes()


SET_SCHEMA = "k long, n int, l int, prefix int, centre double, tokens binary, shared int, bins binary, blocks binary"


def _sets(counted: DataFrame, hot: int = HOT) -> DataFrame:
    """The classes that can have a partner: size, l, length of the prefix, centrality, and shared shingles in the global order, with the
    number of blocks that the classes of each fall into."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in packing.groups(batches):
            parts = []
            for b in rows:
                for blob in b.column(1):
                    own, n, index, token, df = packing.unpack(blob.as_buffer(), "<u8", "<u4", "<u4", "<u8", "<u4")
                    parts.append((own[index], n[index], token, df))
            key, n, token, df = (np.concatenate(x) for x in zip(*parts))
            del parts
            order = np.lexsort((token, df, key))
            key, n, token, df = key[order], n[order].astype(np.int64), token[order], df[order]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            stop = np.append(start[1:], len(key))
            alive = np.flatnonzero(stop - start >= need(n[start]))
            for lo in range(0, len(alive), 256):
                out: list[list] = [[] for _ in range(9)]
                for i in alive[lo : lo + 256]:
                    a, b = start[i], stop[i]
                    l, p = prefix(int(n[a]), df[a:b])
                    for column, x in zip(out, (int(key[a].view(np.int64)), int(n[a]), l, p, float(df[a:b].sum()) / float(n[a]), token[a:b].astype("<u8").tobytes(), int(b - a), _bins(token[a:b]), np.minimum(-(-df[a:b].astype(np.int64) // hot), 65535).astype("<u2").tobytes())):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()))], ["k", "n", "l", "prefix", "centre", "tokens", "shared", "bins", "blocks"])

    return counted.mapInArrow(apply, SET_SCHEMA)


POSTING = "token long, label long, centre double, k long, n int, l int, shared int, bins binary, side int"


def _postings(sets: DataFrame, sketch: bool = False, split: bool = True) -> DataFrame:
    """(token, label, centre, k, n, l, shared, bins, side) of the few shared shingles of least hash, or of every shingle in a prefix. ``sets`` has a
    column label. Token stands for a group: a shingle, or part of one whose classes fall
    into several blocks (unless not to be ``split``); for a sketch a block is a group (side 1), else each pair of blocks is (side 1 and 2; side 0: every pair counts)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                held = [np.frombuffer(t.as_buffer(), "<u8") for t in part.column(5)]
                blocks_of = [np.frombuffer(t.as_buffer(), "<u2") for t in part.column(9)]
                if sketch:
                    at = [np.argpartition(bt.mix(t), SKETCH)[:SKETCH] if len(t) > SKETCH else np.arange(len(t)) for t in held]
                else:
                    at = [np.arange(c) for c in part.column(3).to_numpy()]
                token = np.concatenate([t[x] for t, x in zip(held, at)])
                blocks = np.concatenate([t[x] for t, x in zip(blocks_of, at)]).astype(np.int64) if split else np.ones(len(token), np.int64)
                row = np.repeat(np.arange(part.num_rows), [len(x) for x in at])
                own = (bt.mix(part.column(0).to_numpy()[row].view(np.uint64) + U(7)) % blocks.astype(np.uint64)).astype(np.int64)
                side = np.zeros(len(row), np.int32)
                if sketch:
                    parted = blocks > 1
                    token, side = np.where(parted, bt.mix(token ^ bt.mix(own.astype(np.uint64) + U(1))), token), parted.astype(np.int32)
                elif (blocks > 1).any():
                    take_ = np.repeat(np.arange(len(row)), blocks)
                    other = np.arange(len(take_)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    row, token, own, blocks = row[take_], token[take_], own[take_], blocks[take_]
                    first, second = np.minimum(own, other), np.maximum(own, other)
                    token = np.where(blocks > 1, bt.mix(token ^ bt.mix((first * (1 << 31) + second + 1).astype(np.uint64))), token)
                    side = np.where(first == second, 0, np.where(own == first, 1, 2)).astype(np.int32)
                take = lambda c: pa.array(part.column(c).to_numpy()[row])
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), take(6), take(4), take(0), take(1), take(2), take(7), part.column(8).take(pa.array(row)), pa.array(side)], ["token", "label", "centre", "k", "n", "l", "shared", "bins", "side"])

    return sets.select("k", "n", "l", "prefix", "centre", "tokens", "label", "shared", F.lit(b"").alias("bins") if sketch else "bins", "blocks").mapInArrow(apply, POSTING)


def _like(na: np.ndarray, nb: np.ndarray, shared_a: np.ndarray, shared_b: np.ndarray) -> np.ndarray:
    """Whether sizes and numbers of shared shingles allow the similarity: the overlap has to reach PERCENT / (100 + PERCENT) of both sizes together."""
    return (100 + PERCENT) * np.minimum(shared_a, shared_b).astype(np.int64) >= PERCENT * (na.astype(np.int64) + nb)


PAIRS = "a long, b long, hits long, l int"


def _pairs_table(a, b, least) -> pa.RecordBatch | None:
    if not len(a):
        return None
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((hi, lo))
    lo, hi, least = lo[order], hi[order], least[order]
    at = np.flatnonzero(np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
    return pa.RecordBatch.from_arrays([pa.array(lo[at]), pa.array(hi[at]), pa.array(np.diff(np.append(at, len(lo))), pa.int64()), pa.array(least[at].astype(np.int32))], ["a", "b", "hits", "l"])


def _central_pairs(postings: DataFrame) -> DataFrame:
    """Pairs of each class with the most central class of the group and with the one before it; rows stream by."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = before = None  # (token, k, n, l, shared)
        for batch in batches:
            token, _, _, k, n, l, shared = (batch.column(c).to_numpy() for c in range(7))
            if not len(token):
                continue
            if before is not None:
                token, k, n, l, shared = (np.concatenate([[h, p], x]) for h, p, x in zip(head, before, (token, k, n, l, shared)))
            index = np.arange(len(token))
            new = np.append(True, token[1:] != token[:-1])
            pivot = np.maximum.accumulate(np.where(new, index, 0))
            fresh = index >= (2 if before is not None else 0)
            pairs = [(pivot, fresh & ~new), (index - 1, fresh & ~new & (index - 1 != pivot))]
            a = np.concatenate([p[m] for p, m in pairs])
            b = np.concatenate([index[m] for _, m in pairs])
            ok = _like(n[a], n[b], shared[a], shared[b]) & (k[a] != k[b])
            a, b = a[ok], b[ok]
            if (out := _pairs_table(k[a], k[b], np.ones(len(a), np.int32))) is not None:
                yield out
            last, first = len(token) - 1, pivot[-1]
            head, before = tuple(x[first] for x in (token, k, n, l, shared)), tuple(x[last] for x in (token, k, n, l, shared))

    return postings.mapInArrow(apply, PAIRS)


def _cross_pairs(postings: DataFrame) -> DataFrame:
    """All pairs of classes of different components under the same shingle."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for _, rows in packing.groups(batches):
            label, k, n, l, shared, side = (np.concatenate([b.column(c).to_numpy() for b in rows]) for c in (1, 3, 4, 5, 6, 8))
            if label[0] == label[-1]:  # sorted by component within the shingle
                continue
            order = np.argsort(n, kind="stable")
            label, k, n, l, shared, side = label[order], k[order], n[order], l[order], shared[order], side[order]
            bins = np.frombuffer(b"".join(x.as_py() for b in rows for x in b.column(7)), np.uint8).reshape(-1, BINS)[order]
            boundless = bins[:, 0] == 255
            upto = np.searchsorted(n, (100 * n.astype(np.int64)) // PERCENT, "right")
            for i in range(len(k)):
                span = slice(i + 1, upto[i])
                other = np.flatnonzero((label[span] != label[i]) & ((side[span] != side[i]) | (side[i] == 0)) & _like(n[span], n[i : i + 1], shared[span], shared[i : i + 1])) + i + 1
                if len(other):
                    bound = np.minimum(bins[other], bins[i]).sum(1, dtype=np.int64)
                    near = (100 + PERCENT) * bound >= PERCENT * (n[other].astype(np.int64) + n[i])
                    other = other[near | boundless[other] | boundless[i]]
                if len(other):
                    held.append((np.full(len(other), k[i]), k[other], np.minimum(l[other], l[i])))
                    size += len(other)
                if size > 1 << 20:
                    yield _pairs_table(*(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
        if size:
            yield _pairs_table(*(np.concatenate(x) for x in zip(*held)))

    return postings.mapInArrow(apply, PAIRS)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the candidates that share enough within their prefixes and whose sets are alike."""
    wanted = pairs.groupBy("a", "b").agg(F.sum("hits").alias("hits"), F.max("l").alias("l")).where("hits >= l").select("a", "b")
    side = lambda c: sets.select(F.col("k").alias(c), F.col("n").alias("n" + c), F.col("tokens").alias("t" + c))
    both = wanted.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ta", "tb")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            common = np.array([len(np.intersect1d(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), True)) for x, y in zip(batch.column(4), batch.column(5))], np.int64)
            ok = 100 * common >= PERCENT * (na.astype(np.int64) + nb - common)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], ["a", "b"])

    return both.mapInArrow(apply, "a long, b long")


def _heads(sets: DataFrame, start: DataFrame) -> DataFrame:
    """Postings of the most central class of each block of a split shingle, under the shingle itself. Blocks meet as partial maxima."""
    heads = start.where("side = 1").groupBy("token").agg(F.max_by("k", F.struct("centre", -F.col("k"))).alias("k")).select("k").distinct()
    return _postings(sets.join(heads, "k", "left_semi").withColumn("label", F.col("k")), True, False)


def link(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document. Shingles of more than ``hot`` classes are split."""
    spark = docs.sparkSession
    width = tables.width(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = tables.materialize(classes(docs), "near-classes")
    pieces = max(1, -(-(own.agg(F.sum("n")).first()[0] or 0) // (width * PIECE)))
    slots = width * pieces
    dealt = lambda rows: rows.repartitionById(width, (F.col("slot") / pieces).cast("int")).sortWithinPartitions("slot")
    counted = _count(dealt(_send(docs.where(F.col("doc_id").isNotNull()), slots)), slots)
    sets = tables.materialize(_sets(dealt(counted), hot), "near-sets")
    start = _postings(sets.withColumn("label", F.col("k")), True)
    by_centre = lambda rows: rows.repartition(width, "token").sortWithinPartitions("token", F.col("centre").desc(), "k")
    central = _central_pairs(by_centre(start))
    links = tables.materialize(_verified(central.unionAll(_central_pairs(by_centre(_heads(sets, start)))), sets), "near-links")
    labels = components.components(links)
    labelled = sets.join(labels.withColumnRenamed("node", "k"), "k", "left").withColumn("label", F.coalesce("component", "k"))
    rest = _postings(labelled).repartition(width, "token").sortWithinPartitions("token", "label")
    more = tables.materialize(_verified(_cross_pairs(rest), sets), "near-links")
    if not more.isEmpty():
        links = links.unionAll(more)
        labels = components.components(links)
    n_of = F.when(F.col("n") > 0, F.col("k"))
    nodes = own.where(F.col("doc_id").isNotNull()).withColumn("node", n_of)
    least = nodes.where("n > 0").groupBy("node", "k2").agg(F.min("doc_id").alias("least"))  # hot classes meet as partial minima
    named = least.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(whole, "component").select("node", "k2", "component_id")
    out = own.withColumn("node", n_of).join(named, ["node", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one of least doc_id; rows without doc_id stay. Of several rows of that doc_id, even of different
    texts, the one of least hash stays."""
    kept = link(docs).where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.struct(F.xxhash64(F.col("text").cast("string")), F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])))).alias("h"))
    one = rows.where("id is not null").join(kept, "id", "left_semi").groupBy("id").agg(F.min_by("row", "h").alias("row"))
    return one.select("row.*").unionByName(docs.where(F.col("doc_id").isNull()))


def op4_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(tables.read(spark, sf_dir, "documents").select("doc_id", "text"))
