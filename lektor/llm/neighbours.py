"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Rows fall into blocks. In a block every vector, less the block's centre, is scaled to length one, rotated by one random orthogonal matrix
and reduced to the signs of its coordinates, packed into 64-bit words; two correction scalars stay beside the code: the distance to the
centre and the inner product of the vector with its own code. A query is rotated too and rounded to ``PLANES`` bit planes, so that the
product with a code is a few popcounts. Estimate and error bound follow from the scalars: with a = <code, vector>,
``|error| <= EPSILON * sqrt((1 - a^2) / a^2 / (d - 1)) * |query|`` but for a chance that shrinks with ``exp(-EPSILON^2 / 2)``, plus the rounding of the
query. Vectors whose upper bound reaches the k-th best exact score so far are scored exactly, in double precision on the original
components added in order; the rest are skipped. No row is left out of the index and none is sampled.

The stated query set meets all rows in blocks: a row goes to one block (one for each ``QUERY_GROUP`` queries) as it is stored, and is coded there
once; the queries are streamed past the block, so a task holds the rows of its block and one batch of queries, however many there
are. Of each block at most k rows a query come back. Rows are moved once and queries as often as there are blocks, of ``ROW_BLOCK`` rows where
there are many. All block numbers are hashes, so equal vectors spread.

Defined results: vectors that are null, zero, empty or hold null or non-finite components take no part, nor do rows with a null vec_id;
rows that repeat vec_id and vector count once; a vec_id with several vectors is a candidate (and a query) with each, but never its own
candidate; vectors of different lengths are never compared; ties go to the smaller vec_id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lektor.llm import tables

K, EVERY, ROW_BLOCK, QUERY_GROUP, PLANES, EPSILON, SEED, CELLS, DENSE = 20, 20, 1 << 15, 1 << 20, 6, 3.2, 11, 1 << 18, 0.1
_rotations: dict[int, np.ndarray] = {}


def rotation(d: int) -> np.ndarray:
    if d not in _rotations:
        q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(SEED)).normal(size=(d, d)))
        _rotations[d] = q * np.sign(np.diag(r))
    return _rotations[d]


def exact(columns: np.ndarray, rows: np.ndarray, query_columns: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products of pairs in double precision, components (first axis) added in order, so that equal vectors score equally."""
    total = np.zeros(len(rows))
    for own, other in zip(columns, query_columns):
        total += own[rows] * other[queries]
    return total


class Codes:
    """One-bit codes of a block."""

    def __init__(self, vectors: np.ndarray):
        self.d = vectors.shape[1]
        self.centre = vectors.mean(0)
        moved = vectors - self.centre
        self.length = np.sqrt((moved * moved).sum(1))
        turned = (moved / np.maximum(self.length, 1e-300)[:, None]) @ rotation(self.d)
        bits = turned > 0
        self.own = np.abs(turned).sum(1) / math.sqrt(self.d)
        padded = np.zeros((len(vectors), -(-self.d // 64) * 64), bool)
        padded[:, : self.d] = bits
        self.packed = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
        self.ones = bits.sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            inverse = np.where(self.own > 0, self.length / self.own, 0)
            slack = np.sqrt(np.maximum(0, 1 - self.own**2)) / math.sqrt(max(self.d - 1, 1))
        self.scale, self.by_norm, self.by_step = inverse / math.sqrt(self.d), EPSILON * slack * inverse + 1e-9 * (self.length + 1), inverse * math.sqrt(self.d) / 2

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimate, most that the true product can exceed it) for every query and vector of the block."""
        turned = queries @ rotation(self.d)
        low = turned.min(1)
        step = np.maximum((turned.max(1) - low) / ((1 << PLANES) - 1), 1e-300)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint64)
        planes = np.zeros((PLANES, len(queries), self.packed.shape[1] * 64), bool)
        for k in range(PLANES):
            planes[k, :, : self.d] = (level >> np.uint64(k)) & np.uint64(1)
        planes = np.packbits(planes, axis=2, bitorder="little").view(np.uint64)
        hit = np.zeros((len(queries), len(self.packed)), np.uint32)
        for k in range(PLANES):
            for w in range(self.packed.shape[1]):
                hit += np.left_shift(np.bitwise_count(self.packed[:, w] & planes[k, :, w, None]), k, dtype=np.uint32)
        # sum over set bits of the rounded query, less the sum over the others
        estimate = hit * (2 * step)[:, None]
        estimate += (2 * low)[:, None] * self.ones
        estimate -= (low * self.d + step * level.sum(1))[:, None]
        estimate *= self.scale
        estimate += (queries @ self.centre)[:, None]
        return estimate, np.sqrt((queries * queries).sum(1))[:, None] * self.by_norm + step[:, None] * self.by_step


def search(codes: Codes, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score): the best k of the block for every query, by codes first and exact scores last."""
    n, columns, out = len(ids), np.ascontiguousarray(vectors.T), []
    batch = max(1, CELLS // n)
    for lo in range(0, len(query_ids), batch):
        names, asked = query_ids[lo : lo + batch], queries[lo : lo + batch]
        query_columns = np.ascontiguousarray(asked.T)
        keep = ids != names[:, None]
        if n > 4 * k:
            estimate, most = codes.bounds(asked)
            estimate[~keep] = -np.inf
            first = np.argpartition(estimate, n - 2 * k, axis=1)[:, n - 2 * k :]
            who = np.repeat(np.arange(len(names)), 2 * k)
            score = np.where(keep[who, first.ravel()], exact(columns, first.ravel(), query_columns, who), -np.inf).reshape(first.shape)
            most += estimate
            keep &= most >= np.partition(score, k, axis=1)[:, k, None]  # the k-th best of 2 k
        if keep.mean() > DENSE:  # pairs are many: score whole columns
            total, product = np.zeros(keep.shape), np.empty(keep.shape)
            for own, other in zip(columns, query_columns):
                total += np.multiply(own, other[:, None], out=product)
            total[~keep] = -np.inf
            if n > k:
                keep &= total >= np.partition(total, n - k, axis=1)[:, n - k, None]
            who, row = np.nonzero(keep)
            score = total[who, row]
        else:
            who, row = np.nonzero(keep)
            score = exact(columns, row, query_columns, who)
        order = np.lexsort((ids[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        best = np.arange(len(who)) - np.searchsorted(who, who) < k
        out.append((names[who[best]], ids[row[best]], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def usable(vectors: DataFrame) -> DataFrame:
    v = F.col("vec").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(ok, F.lit(False))).dropDuplicates(["vec_id", "vec"])


def nearest(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that ``is_query`` marks, over all rows of ``vectors`` (vec_id, vec)."""
    rows = tables.materialize(usable(vectors).withColumn("q", F.coalesce(is_query, F.lit(False))).withColumn("h", F.xxhash64("vec_id", F.lit(SEED))), "vectors")
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).first()
    n_rows = max(1, math.ceil(n.n / ROW_BLOCK), min(tables.width(rows.sparkSession), math.ceil(n.n / 1024)))
    n_groups = max(1, math.ceil(n.q / QUERY_GROUP))
    rb, qg = F.pmod(F.col("h"), F.lit(n_rows)), F.pmod(F.col("h"), F.lit(n_groups))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    row = lambda kind, block, group: rows.where("q" if kind else "true").withColumn("b", block).withColumn("g", group).select((F.col("b") * n_groups + F.col("g")).cast("int").alias("block"), F.size("vec").alias("d"), F.lit(kind).alias("kind"), "vec_id", "vec")
    both = row(0, rb, every(n_groups)).unionByName(row(1, every(n_rows), qg))
    dealt = both.repartitionById(n_rows * n_groups, F.col("block")).sortWithinPartitions("block", "d", "kind")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        codes = ids = vectors = key = None
        for batch in batches:
            block, d, kind, names = (batch.column(c).to_numpy() for c in range(4))
            if not len(block):
                continue
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(d) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip(np.append(0, cuts).tolist(), np.append(cuts, len(block)).tolist()):
                table = batch.column(4).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(hi - lo, -1)
                if key != (block[lo], d[lo]):
                    key, held, codes = (block[lo], d[lo]), [], None
                if kind[lo] == 0:
                    held.append((names[lo:hi], table))
                elif held:
                    if codes is None:
                        ids, vectors = (np.concatenate(x) for x in zip(*held))
                        held, codes = [(ids, vectors)], Codes(vectors)
                    q, v, score = search(codes, ids, vectors, names[lo:hi], table, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(apply, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = tables.read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    return nearest(vectors, F.col("vec_id") % EVERY == 0)


OP7_SQL = f"""
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % {EVERY} = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
