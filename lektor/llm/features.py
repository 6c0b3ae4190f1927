"""Sparse text features for the classifiers: hashed words and structure statistics of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektor.llm import bytetext as bt

STRUCTURE = ("bias", "log_bytes", "log_words", "upper", "digit", "other_ascii", "high", "newline", "word_len", "repeat", "gap_share", "log_meta_chars")
_UPPER, _DIGIT, _OTHER = (np.zeros(257, np.int64) for _ in range(3))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _OTHER[_c] = 1


def _per_doc(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def stems(block: bt.Block, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, bucket, count): distinct hashed lower-case words, cut at ASCII punctuation, and their first four and five bytes."""
    data = bt.lowered(block.data)
    data = np.where(_OTHER[data] > 0, np.uint8(32), data)
    starts, ends, first = bt.words(data, block.offsets)
    sums = bt.prefix_sums(data)
    doc = np.repeat(np.arange(len(block)), np.diff(first))
    hashed, owner = [bt.span_hashes(sums, starts, ends)], [doc]
    for k in (4, 5):
        longer = ends - starts > k
        hashed.append(bt.mix(bt.span_hashes(sums, starts[longer], starts[longer] + k) + np.uint64(k)))
        owner.append(doc[longer])
    key = (np.concatenate(owner).astype(np.int64) << bits) | (np.concatenate(hashed) >> np.uint64(64 - bits)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    return np.searchsorted(key >> bits, np.arange(len(block) + 1)), key & ((1 << bits) - 1), count


def rows(block: bt.Block, bits: int, meta_chars: np.ndarray | None = None, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, bucket, count, structure) of a block: distinct hashed words of each document with their counts, and its statistics."""
    data, offsets, n = block.data, block.offsets, len(block)
    starts, ends, first = bt.words(data, offsets)
    hashed = bt.word_hashes(bt.lowered(data) if lower else data, starts, ends)
    doc = np.repeat(np.arange(n), np.diff(first))
    key = (doc.astype(np.int64) << bits) | (hashed >> np.uint64(64 - bits)).astype(np.int64)
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    size = np.diff(offsets).astype(float)
    n_words = np.diff(first).astype(float)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(n_words, 1)
    begin = np.searchsorted(key >> bits, np.arange(n + 1))
    letters = _per_doc((ends - starts), first) if len(starts) else np.zeros(n)
    chars = size if meta_chars is None else np.where(np.isnan(meta_chars), size, meta_chars)
    structure = np.stack([
        np.ones(n), np.log1p(size) / 10, np.log1p(n_words) / 8, _per_doc(_UPPER[data], offsets) * per_byte, _per_doc(_DIGIT[data], offsets) * per_byte,
        _per_doc(_OTHER[data], offsets) * per_byte, _per_doc(data >= 128, offsets) * per_byte, np.minimum(1, 10 * _per_doc(data == 10, offsets) * per_byte),
        letters * per_word / 10, 1 - np.diff(begin) * per_word * (n_words > 0), 1 - letters * per_byte, np.log1p(np.maximum(chars, 0)) / 10,
    ], axis=1)
    return begin, (key & ((1 << bits) - 1)), count, structure


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, held_out: int | None, seed: int, bits: int, stemmed: bool = False) -> list:
    """Features of a bounded sample of labelled rows: at most ``per_class`` documents of each class, the first by a hash of their id.

    Rows whose crc32(doc_id) mod 4 is ``held_out`` are never taken. A document labelled more than once counts with its highest
    label; null ids and labels are left out; of several texts of one id the one of least hash is learned from. Returns (label, meta, buckets, counts, structure) rows, at most 2 * per_class.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    if held_out is not None:
        ids = ids.where(F.crc32(F.col("doc_id").cast("string")) % 4 != held_out)
    ids = ids.withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))
    chosen = [r for y in (F.col("y") <= 0, F.col("y") > 0) for r in ids.where(y).orderBy("_h", "doc_id").limit(per_class).select("doc_id", (F.col("y") > 0).cast("int").alias("y")).collect()]
    if not chosen:
        return []
    spark = docs.sparkSession
    small = spark.createDataFrame([(int(r.doc_id), int(r.y)) for r in chosen], "doc_id long, y int")  # at most 2 * per_class rows
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("double").alias("meta")]
    found = docs.select(*cols).join(F.broadcast(small), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("y", "text", "meta"), F.struct(F.xxhash64("text"), "meta")).alias("r")).select("doc_id", "r.y", "r.text", "r.meta")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bt.blocks(batch.column(2)):
                meta = batch.column(3).slice(block.lo, len(block)).to_numpy(zero_copy_only=False).astype(float)
                begin, bucket, count, structure = (*stems(block, bits), np.zeros((len(block), 0))) if stemmed else rows(block, bits, meta)
                y, ids_ = batch.column(1).slice(block.lo, len(block)), batch.column(0).slice(block.lo, len(block))
                yield pa.RecordBatch.from_arrays([ids_, y, pa.array([bucket[a:b].astype(np.int32).tobytes() for a, b in zip(begin, begin[1:])], pa.binary()), pa.array([count[a:b].astype(np.uint32).tobytes() for a, b in zip(begin, begin[1:])], pa.binary()), pa.array([x.astype(np.float32).tobytes() for x in structure], pa.binary())], ["doc_id", "y", "b", "c", "s"])

    return sorted(found.mapInArrow(encode, "doc_id long, y int, b binary, c binary, s binary").collect(), key=lambda r: r.doc_id)
