"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

``score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))``: the pairwise interactions of all features cost
time linear in their number by the sum-of-squares identity. Words enter with their share of the document, so that long and short texts
compare; structure statistics cover letter case, symbols, digits, white space, repetition and lengths, and the column ``n_chars``, where
there is one, is metadata. Labels, language, source and doc_id are no inputs.

Defined results: a null text is the empty text and gets the score of its structure statistics; a null ``n_chars`` is replaced by the
length in bytes; equal rows get equal scores and stay separate; an empty table gives an empty result; without any labelled row every
score is 0.5. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lektor.llm import bytetext as bt
from lektor.llm import features, tables

BITS, RANK, PER_CLASS, HELD_OUT, THRESHOLD = 14, 6, 2500, 2, 0.7


@dataclass
class Machine:
    """Weights of the hashed words followed by those of the structure statistics."""

    bits: int
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    prior: float = 0.0

    def scaled(self, structure: np.ndarray) -> np.ndarray:
        """Structure statistics with the sample's mean and spread taken out, but for the constant."""
        return np.clip((structure - self.mean) / self.spread, -8, 8)

    def raw(self, first: np.ndarray, bucket: np.ndarray, share: np.ndarray, structure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score before the sigmoid, factor sums) of each document."""
        n = len(structure)
        base = 1 << self.bits

        def total(values: np.ndarray) -> np.ndarray:
            out = np.zeros((len(values) + 1, *values.shape[1:]))
            np.cumsum(values, axis=0, out=out[1:])
            return out[first[1:]] - out[first[:-1]]

        v, vs = self.factors[bucket] * share[:, None], self.factors[base:]
        s = total(v) + structure @ vs
        q = total(v * v) + (structure**2) @ (vs**2)
        lin = total(self.linear[bucket] * share) + structure @ self.linear[base:]
        return (self.bias + lin + 0.5 * (s * s - q).sum(1)) if n else np.zeros(0), s

    def score(self, first, bucket, share, structure) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(first, bucket, share, self.scaled(structure))[0] + self.prior, -30, 30)))


def shares(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Square roots of the words' shares: the squares of a document sum to one."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    total = np.bincount(doc, count, len(first) - 1)
    return np.sqrt(count / np.maximum(total[doc], 1)) if len(doc) else np.zeros(0)


def fit(sample: list, share: float = 0.5, bits: int = BITS, rank: int = RANK, epochs: int = 8, steps: int = 600, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss over a bounded sample, classes weighted alike; ``share`` of class 1 among all labels sets the prior."""
    rng = np.random.Generator(np.random.PCG64(seed))
    base, extra = 1 << bits, len(features.STRUCTURE)
    model = Machine(bits, 0.0, np.zeros(base + extra), rng.normal(0, 0.02, (base + extra, rank)), np.zeros(extra), np.ones(extra))
    if not sample:
        model.factors[:] = 0
        return model
    table = np.stack([np.frombuffer(r.s, np.float32) for r in sample]).astype(float)
    model.mean[1:], model.spread[1:] = table[:, 1:].mean(0), np.maximum(table[:, 1:].std(0), 1e-3)
    model.prior = float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0
    y = np.array([r.y for r in sample], float)
    rows = [(np.frombuffer(r.b, np.int32), np.frombuffer(r.c, np.uint32).astype(float), model.scaled(np.frombuffer(r.s, np.float32).astype(float))) for r in sample]
    rows = [(b, np.sqrt(c / max(c.sum(), 1)), s) for b, c, s in rows]
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    g_lin, g_fac, g_bias = np.full(base + extra, 1e-2), np.full((base + extra, rank), 1e-2), 1e-2
    for _ in range(max(epochs, -(-steps * 64 // len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            first = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in part])])
            bucket, part_share = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            structure = np.stack([rows[i][2] for i in part])
            raw, s = model.raw(first, bucket, part_share, structure)
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) * weight[part] / len(part)
            doc = np.repeat(np.arange(len(part)), np.diff(first))
            index = np.concatenate([bucket, np.tile(np.arange(base, base + extra), len(part))])
            x = np.concatenate([part_share, structure.ravel()])
            d = np.concatenate([doc, np.repeat(np.arange(len(part)), extra)])
            used, inv = np.unique(index, return_inverse=True)
            gl = np.bincount(inv, err[d] * x, len(used)) + decay * model.linear[used]
            fx = model.factors[index]
            pull = (err[d] * x)[:, None] * (s[d] - fx * x[:, None])
            gf = np.stack([np.bincount(inv, pull[:, k], len(used)) for k in range(rank)], 1) + decay * model.factors[used]
            g_lin[used] += gl * gl
            g_fac[used] += gf * gf
            g_bias += err.sum() ** 2
            model.linear[used] -= rate * 3 * gl / np.sqrt(g_lin[used])
            model.factors[used] -= rate * gf / np.sqrt(g_fac[used])
            model.bias -= rate * err.sum() / np.sqrt(g_bias)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, held_out: int | None = HELD_OUT, seed: int = 7) -> Machine:
    sample = features.labelled_sample(docs, labels, "quality", per_class, held_out, seed, BITS)
    known = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != held_out) if held_out is not None else labels
    share = known.select(F.avg((F.col("quality") > 0).cast("double")).alias("s")).first().s
    return fit(sample, share if share is not None else 0.5, seed=seed)


def score(docs: DataFrame, model: Machine, column: str = "score") -> DataFrame:
    """``docs`` with its score appended; one pass over the texts, no shuffle."""
    kept = [c for c in docs.columns if c != column]
    meta = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").cast("string").alias("_lektor_text"), meta.alias("_lektor_meta"))
    n, shared = len(kept), docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            for block in bt.blocks(batch.column(n)):
                part = batch.slice(block.lo, len(block))
                meta_chars = part.column(n + 1).to_numpy(zero_copy_only=False).astype(float)
                first, bucket, count, structure = features.rows(block, machine.bits, meta_chars)
                got = machine.score(first, bucket, shares(first, count), structure)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(got, pa.float64())], [*kept, column])

    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0.0).alias(column)).schema
    return source.mapInArrow(apply, schema)


def keep_good(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns."""
    return score(docs, model, "_lektor_score").where(F.col("_lektor_score") >= threshold).drop("_lektor_score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = train(docs, tables.read(spark, sf_dir, "labels"))
    got = score(docs, model).select("doc_id", "score")
    return got.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
