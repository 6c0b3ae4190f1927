"""Token-id files: whole texts as ids of a public tokenizer in Simple-8b blocks, written in ascending doc_id order and read back.

A file (``.s8b``) holds: the magic ``LKS8B001``; blocks of Simple-8b words, little-endian; a footer with the blocks' byte offsets, id counts and word
counts and the documents' ids and token counts; the footer's offset and sizes; the magic again. Each block decodes by itself, so a reader can
start at any block.

Writing: texts are tokenised where they are read; ids go once through a shuffle to ranges of doc_id, each range is sorted and streamed into
files of bounded size. File names carry the task attempt; only files named by the manifest, a table that Spark commits task by task,
count, so a lost executor or a repeated attempt leaves nothing but unnamed files. The starts of files are sums over the manifest.

Tokenising: the tokenizer drops white space and merges only within a word, so every distinct word (ASCII letters lowered) is encoded once
by the tokenizers library and its ids are reused; a bounded cache of words lives as long as the Python worker.

Defined results: a null text is empty and yields the end id alone; null doc_ids come first; equal doc_ids stand side by side, ordered by
their ids' checksum; an empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lektor.llm import bytetext as bt
from lektor.llm import simple8b, tables

MAGIC = b"LKS8B001"
BLOCK_IDS, FILE_IDS, CACHE_WORDS, END_ID = 1 << 15, 1 << 24, 1_500_000, 1
_workers: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of words by way of a bounded cache: sorted hashes, where their ids start, and all ids in a row."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.hashes, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def one(self, word: bytes) -> list[int]:
        if word.isalpha() and word.isascii():  # one run of letters: no other step of the tokenizer touches it
            return [t.id for t in self.tokenizer.model.tokenize(word.decode().lower())]
        body = word[:-1]
        if body.isalpha() and body.isascii() and word[-1:] in (b".", b","):
            return [t.id for part in (body, word[-1:]) for t in self.tokenizer.model.tokenize(part.decode().lower())]
        return self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids

    def add(self, hashes: np.ndarray, found: list[bytes]) -> None:
        if len(self.hashes) + len(hashes) > CACHE_WORDS:
            self.clear()
        got = [self.one(w) for w in found]
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for x in got for i in x), np.uint32, int(size.sum()))
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, flat])
        where = np.searchsorted(self.hashes, hashes)
        self.hashes, self.at, self.size = np.insert(self.hashes, where, hashes), np.insert(self.at, where, at), np.insert(self.size, where, size)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block and each document's first (one more entry at the end)."""
        if b"<|" not in data.tobytes():  # a special token's string in other letters is ordinary text
            data = bt.lowered(data)
        starts, ends, first = bt.words(data, offsets)
        hashed = bt.word_hashes(data, starts, ends)
        distinct, example, index = np.unique(hashed, return_index=True, return_inverse=True)
        spot = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[spot] != distinct) if len(self.hashes) else np.arange(len(distinct))
        if len(new):
            if len(self.hashes) + len(new) > CACHE_WORDS:
                self.clear()
                new = np.arange(len(distinct))
            raw = data.tobytes()
            self.add(distinct[new], [raw[starts[i] : ends[i]] for i in example[new]])
        spot = np.searchsorted(self.hashes, distinct)
        size = self.size[spot][index] if len(distinct) else np.zeros(0, np.int64)
        at = self.at[spot][index] if len(distinct) else np.zeros(0, np.int64)
        total = np.append(0, np.cumsum(size))
        pick = np.repeat(at - total[:-1], size) + np.arange(total[-1])
        return self.ids[pick], total[first]


def encoder(path: str) -> WordEncoder:
    if path not in _workers:
        _workers[path] = WordEncoder(path)
    return _workers[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): little-endian 32-bit ids of each text, the end id last."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            for block in bt.blocks(batch.column(1)):
                ids, first = words.encode(block.data, block.offsets)
                n = len(block)
                out = np.insert(ids.astype("<u4"), first[1:], END_ID)
                ends = (first + np.arange(n + 1)) * 4
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, n), packed], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(apply, "doc_id long, ids binary")


class _Writer:
    """One file at a time; ``rows`` are the manifest entries of those that are closed."""

    def __init__(self, folder: str, part: int):
        from pyarrow import fs

        self.files, self.base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        self.files.create_dir(self.base, recursive=True)
        self.part, self.seq, self.out, self.rows = part, 0, None, []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        if self.out is None:
            self.name = f"{self.part:08d}-{self.seq:06d}-{uuid.uuid4().hex}.s8b"
            self.out = self.files.open_output_stream(f"{self.base}/{self.name}")
            self.out.write(MAGIC)
            self.pos, self.docs, self.sizes, self.blocks, self.queue, self.queued, self.n = 8, [], [], [], [], 0, 0
        self.docs.append(-(2**63) if doc is None else doc)
        self.sizes.append(len(ids))
        self.queue.append(ids)
        self.queued += len(ids)
        self.n += len(ids)
        if self.queued >= BLOCK_IDS:
            self.flush()
        if self.n >= FILE_IDS:
            self.close()

    def flush(self) -> None:
        ids = np.concatenate(self.queue)
        for lo in range(0, len(ids), BLOCK_IDS):
            part = ids[lo : lo + BLOCK_IDS]
            words = simple8b.encode(part)
            self.out.write(words.astype("<u8").tobytes())
            self.blocks.append((self.pos, len(part), len(words)))
            self.pos += 8 * len(words)
        self.queue, self.queued = [], 0

    def close(self) -> None:
        if self.out is None:
            return
        if self.queued:
            self.flush()
        footer = np.array(self.blocks, "<i8").tobytes() + np.array(self.docs, "<i8").tobytes() + np.array(self.sizes, "<i8").tobytes()
        self.out.write(footer + struct.pack("<qqq", self.pos, len(self.blocks), len(self.docs)) + MAGIC)
        self.out.close()
        self.rows.append((self.part, self.seq, self.name, len(self.docs), self.n))
        self.out, self.seq = None, self.seq + 1


def ranges(docs: DataFrame, parts: int) -> list[int]:
    """At most parts - 1 bounds that cut the ids into ranges of about as many rows."""
    at = [k / parts for k in range(1, parts)]
    got = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), at, 20 * parts).alias("b")).first().b if at else None
    return sorted(set(got or []))


def write(docs: DataFrame, path: str, folder: str, parts: int | None = None) -> DataFrame:
    """Tokenise and write ``docs``; returns the manifest (part, seq, name, n_docs, n_ids), a table that Spark has committed."""
    spark = docs.sparkSession
    parts = parts or tables.width(spark)
    bounds = ranges(docs, parts)
    below = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(below).cast("int")
    ids = encoded(docs, path).withColumn("part", part).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), F.crc32("ids"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            docs_, blobs, parts_ = (batch.column(k) for k in range(3))
            for doc, blob, p in zip(docs_.to_pylist(), blobs, parts_.to_pylist()):
                if out is None or out.part != p:
                    if out is not None:
                        out.close()
                        yield rows(out)
                    out = _Writer(folder, p)
                out.add(doc, np.frombuffer(blob.as_buffer(), "<u4"))
        if out is not None:
            out.close()
            yield rows(out)

    def rows(out: _Writer) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({k: [r[i] for r in out.rows] for i, k in enumerate(("part", "seq", "name", "n_docs", "n_ids"))}, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return tables.materialize(ids.mapInArrow(apply, "part int, seq int, name string, n_docs long, n_ids long"), "token-manifest")


def read_file(stream) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """Document ids, their token counts and the blocks' ids of an open file."""
    size = stream.size()
    tail = stream.read_at(32, size - 32)
    if tail[24:] != MAGIC or stream.read_at(8, 0) != MAGIC:
        raise ValueError("no token file")
    at, n_blocks, n_docs = struct.unpack("<qqq", tail[:24])
    footer = np.frombuffer(stream.read_at(size - 32 - at, at), "<i8")
    blocks = footer[: 3 * n_blocks].reshape(-1, 3)
    docs, sizes = footer[3 * n_blocks : 3 * n_blocks + n_docs], footer[3 * n_blocks + n_docs :]
    return docs, sizes, (simple8b.decode(np.frombuffer(stream.read_at(8 * int(w), int(p)), "<u8"), int(n)) for p, n, w in blocks)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents of the files in order, decoded block by block."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    files = files.repartition(max(1, tables.width(manifest.sparkSession)), "part", "seq").select("name", "base")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        source, base_path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with source.open_input_file(f"{base_path}/{name}") as stream:
                    docs, sizes, blocks = read_file(stream)
                    ends = np.cumsum(sizes)
                    held, have, done, at = [], 0, 0, 0
                    for ids in blocks:
                        held.append(ids)
                        have += len(ids)
                        upto = int(np.searchsorted(ends, at + have, "right"))
                        if upto > done and (have > 1 << 18 or upto == len(docs)):
                            flat = np.concatenate(held).astype("<u4")
                            own = ends[done:upto] - at
                            edges = np.append(0, own) * 4
                            packed = pa.Array.from_buffers(pa.binary(), upto - done, [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(flat[: own[-1]].tobytes())])
                            null = docs[done:upto] == -(2**63)
                            yield pa.RecordBatch.from_arrays([pa.array(docs[done:upto], pa.int64(), mask=null), pa.array(base + ends[done:upto] - sizes[done:upto]), pa.array(sizes[done:upto]), packed], ["doc_id", "start", "n_tokens", "ids"])
                            held, have = [flat[own[-1] :].astype(np.uint64)], have - int(own[-1])
                            at, done = int(ends[upto - 1]), upto

    return files.mapInArrow(apply, "doc_id long, start long, n_tokens long, ids binary")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    folder = tables.new_path(spark, "token-files")
    manifest = write(docs, public_tokenizers.path("word_bpe_49k.json"), folder)
    return read(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
