"""SentencePiece encoding and decoding with exact n-best segmentations.

The lattice of a text has an arc for every vocabulary piece that matches somewhere; a character that no piece covers is spelled in byte
pieces at a penalty. Forward Viterbi gives the best score from the start to every position. Those scores are exact heuristics for A-star
search from the end of the text back to its start, which therefore yields segmentations in the order of their scores without expanding a
path twice.

Where two neighbouring bytes stand side by side in no piece of the vocabulary (the start of most words, line breaks, most punctuation), every
path passes: such positions are cut vertices. The lattice of a text is searched segment by segment: forward Viterbi and A-star run once for each
distinct segment (a bounded cache lives as long as the Python worker) and give its two best segmentations; A-star then lists the n best of the n - 1
segments of least gaps, the only ones in which the text's n best differ, and these are combined in score order.

Scores are log-probabilities of pieces. A model of the unigram kind states them; the scores of a BPE model are merge ranks, whose sums
mean nothing, so there a piece of rank r has the probability of Zipf's law, 1 / (r + 1) over the sum of all. Nothing is trained. The ids of the
best segmentation thus differ from those that BPE's own merges reach; ``decodes`` holds for both.

Encoding: a space is put in front of a text that isn't empty, spaces become U+2581. Decoding undoes both; a text holding U+2581 itself decodes
with a space in its place.

Defined results: null and empty texts have no pieces, score 0, and decode to the empty text; where a text has fewer than n segmentations
the missing gaps are null and the list is shorter; repeated rows stay separate; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lektor.llm import bytetext as bt
from lektor.llm import tables

SPACE, UNKNOWN_PENALTY, CACHE = "▁", 10.0, 1_000_000
_workers: dict[str, "Pieces"] = {}


class Pieces:
    """A vocabulary with scores, and a bounded cache of segments: sorted hashes, ids in a row, scores and gaps."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.arcs: dict[str, tuple[float, int]] = {}
        self.byte = {}
        spelled = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                spelled.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                spelled.append(b"")
            else:
                self.arcs[piece] = (sp.get_score(i), i)
                spelled.append(piece.replace(SPACE, " ").encode())
        scores = [w for w, _ in self.arcs.values()]
        if all(float(w).is_integer() for w in scores):  # merge ranks
            top = max(scores)
            total = math.log(sum(1 / (1 + top - w) for w in scores))
            self.arcs = {piece: (-math.log(1 + top - w) - total, i) for piece, (w, i) in self.arcs.items()}
        self.longest = max(map(len, self.arcs))
        self.prefixes: dict[str, tuple[float, int] | tuple[()]] = {}
        self.joined = np.zeros((256, 256), bool)  # pairs of bytes that stand side by side in a piece
        for piece, arc in self.arcs.items():
            for k in range(1, len(piece)):
                self.prefixes.setdefault(piece[:k], ())
            self.prefixes[piece] = arc
            raw = np.frombuffer(piece.replace(SPACE, " ").encode(), np.uint8)
            self.joined[raw[:-1], raw[1:]] = True
        self.joined[:, 0x80:0xC0] = True  # never inside a character
        self.unknown = min(s for s, _ in self.arcs.values()) - UNKNOWN_PENALTY
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_size = np.array([len(x) for x in spelled])
        self.spelled_at = np.cumsum(self.spelled_size) - self.spelled_size
        self.clear()

    def clear(self) -> None:
        self.hashes, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.score, self.gap = np.zeros(0), np.zeros(0)
        self.nexts: dict[tuple[int, int], list[tuple[float, bytes]]] = {}

    def lattice(self, text: str) -> tuple[list[float], list[list[tuple[int, float, int]]]]:
        """Forward Viterbi: for each position the best score from the start, and the arcs that end there (start, score, id; -1 for a character
        spelled in bytes)."""
        get, n = self.prefixes.get, len(text)
        best, arcs = [0.0] + [float("-inf")] * n, [[] for _ in range(n + 1)]
        for s in range(n):
            f, e, covered = best[s], s + 1, False
            while e <= n:
                arc = get(text[s:e])
                if arc is None:
                    break
                if arc:
                    covered = covered or e == s + 1
                    w, piece = arc
                    arcs[e].append((s, w, piece))
                    if f + w > best[e]:
                        best[e] = f + w
                e += 1
            if not covered:
                arcs[s + 1].append((s, self.unknown, -1))
                best[s + 1] = max(best[s + 1], f + self.unknown)
        return best, arcs

    def n_best(self, text: str, n: int = 3) -> list[tuple[float, list[int]]]:
        """The n best segmentations (score, ids), best first: A-star from the end, whose heuristic is the exact score from the start."""
        if not text:
            return [(0.0, [])]
        best, arcs = self.lattice(text)
        push, pop = heapq.heappush, heapq.heappop
        last = len(text)
        heap, turn, out = [(-best[last], 0, last, 0.0, None)], 1, []
        while heap:
            minus, _, at, behind, path = pop(heap)
            if at == 0:
                ids = []
                while path:
                    start, piece, path = path
                    if piece < 0:
                        ids += [self.byte[b] for b in text[start].encode()]
                    else:
                        ids.append(piece)
                out.append((-minus, ids))
                if len(out) == n:
                    break
                continue
            for start, w, piece in arcs[at]:
                g = behind + w
                push(heap, (-(best[start] + g), turn, start, g, (start, piece, path)))
                turn += 1
        return out

    def add(self, hashes: np.ndarray, segments: list[bytes]) -> None:
        """Keep the best segmentation of each segment and how far the second one falls behind."""
        found = [self.n_best(s.decode("utf-8", "replace").replace(" ", SPACE), 2) for s in segments]
        size = np.fromiter((len(f[0][1]) for f in found), np.int64, len(found))
        flat = np.fromiter((i for f in found for i in f[0][1]), np.int32, int(size.sum()))
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, flat])
        where = np.searchsorted(self.hashes, hashes)
        self.hashes, self.at, self.size = np.insert(self.hashes, where, hashes), np.insert(self.at, where, at), np.insert(self.size, where, size)
        self.score = np.insert(self.score, where, [f[0][0] for f in found])
        self.gap = np.insert(self.gap, where, [f[0][0] - f[1][0] if len(f) > 1 else np.inf for f in found])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, scores, gaps): the best ids of all documents in a row, each document's first id (one more at the end), its score and the gaps of
        its next two best segmentations."""
        return self.encode_n(data, offsets, 3)[:4]

    def encode_n(self, data: np.ndarray, offsets: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
        """As ``encode``, for as many best segmentations as asked for, and last the ids (little-endian 32-bit) of each document's second to last one."""
        n = len(offsets) - 1
        size = np.diff(offsets)
        lead = offsets[:-1][size > 0]
        data = np.insert(data, lead, 32)
        offsets = offsets + np.append(0, np.cumsum(size > 0))
        total = len(data)
        if not total:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64), np.zeros(n), np.full((n, best - 1), np.inf), [[] for _ in range(n)]
        cut = np.zeros(total + 1, bool)
        cut[1:total] = ~self.joined[data[:-1], data[1:]]
        cut[offsets] = True
        starts = np.flatnonzero(cut[:total])
        ends = np.append(starts[1:], total)
        hashed = bt.word_hashes(data, starts, ends)
        distinct, example, index = np.unique(hashed, return_index=True, return_inverse=True)
        spot = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[spot] != distinct) if len(self.hashes) else np.arange(len(distinct))
        if len(new):
            if len(self.hashes) + len(new) > CACHE:
                self.clear()
                new = np.arange(len(distinct))
            raw = data.tobytes()
            self.add(distinct[new], [raw[starts[i] : ends[i]] for i in example[new]])
        spot = np.searchsorted(self.hashes, distinct)[index]
        pieces = self.size[spot]
        upto = np.append(0, np.cumsum(pieces))
        ids = self.ids[np.repeat(self.at[spot] - upto[:-1], pieces) + np.arange(upto[-1])]
        first = np.searchsorted(starts, offsets)
        run = np.append(0, np.cumsum(self.score[spot]))
        gaps, others = self._next_best(best, self.gap[spot], first, data, starts, ends, hashed, ids, upto)
        return ids, upto[first], run[first[1:]] - run[first[:-1]], gaps, others

    def _segment_nexts(self, key: int, segment: bytes, own: bytes, best: int) -> list[tuple[float, bytes]]:
        """(gap, ids) of a segment's segmentations behind its best one, whose ids are ``own``, by A-star."""
        got = self.nexts.get((key, best))
        if got is None:
            if len(self.nexts) >= CACHE // 4:
                self.nexts.clear()
            found = self.n_best(segment.decode("utf-8", "replace").replace(" ", SPACE), best)
            packed = [(max(found[0][0] - score, 0.0), np.array(ids, "<u4").tobytes()) for score, ids in found]
            got = self.nexts[key, best] = [x for x in packed if x[1] != own][: best - 1]  # of equal scores another may come first
        return got

    def _next_best(self, best: int, gap: np.ndarray, first: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: np.ndarray, ids: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
        """How far the second to last best segmentations of each text fall behind its best, and their ids.

        They differ from the best in the ``best - 1`` segments of least gaps at most. A-star lists those segments' segmentations; the choices
        across segments are combined in the order of their sums.
        """
        out, others = np.full((len(first) - 1, best - 1), np.inf), [[] for _ in range(len(first) - 1)]
        full = np.flatnonzero(np.diff(first) > 0)
        if best < 2 or not len(full):
            return out, others
        owner = np.repeat(np.arange(len(full)), np.diff(first)[full])
        rest = gap.copy()
        chosen: list[list[int]] = [[] for _ in range(len(full))]
        for _ in range(best - 1):
            least = np.minimum.reduceat(rest, first[full])
            hits = np.flatnonzero((rest == least[owner]) & np.isfinite(rest))
            texts, at = np.unique(owner[hits], return_index=True)
            where = hits[at]
            rest[where] = np.inf
            for t, k in zip(texts.tolist(), where.tolist()):
                chosen[t].append(k)
        raw, text = ids.astype("<u4").tobytes(), data.tobytes()
        for d, ks in zip(full.tolist(), chosen):
            lists = [self._segment_nexts(int(hashed[k]), text[starts[k] : ends[k]], raw[4 * upto[k] : 4 * upto[k + 1]], best) for k in ks]
            lo, hi = 4 * int(upto[first[d]]), 4 * int(upto[first[d + 1]])
            for j, (behind, choice) in enumerate(_combined(lists, best - 1)):
                at, parts = lo, []
                for k, alternatives, c in sorted(zip(ks, lists, choice)):
                    if c:
                        parts += [raw[at : 4 * int(upto[k])], alternatives[c - 1][1]]
                        at = 4 * int(upto[k + 1])
                out[d, j] = behind
                others[d].append(b"".join([*parts, raw[at:hi]]))
        return out, others

    def text_n_best(self, text: str, n: int = 3) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a whole text (score, ids)."""
        return self.n_best((" " + text).replace(" ", SPACE) if text else "", n)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts in a row and where each starts (one more entry): the space in front is taken off again."""
        size = self.spelled_size[ids]
        upto = np.append(0, np.cumsum(size))
        data = self.spelled[np.repeat(self.spelled_at[ids] - upto[:-1], size) + np.arange(upto[-1])]
        offsets = upto[first]
        full = np.diff(offsets) > 0
        return np.delete(data, offsets[:-1][full]), offsets - np.append(0, np.cumsum(full))


def _combined(lists: list[list[tuple[float, bytes]]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n least sums of gaps with one choice a list (0: none, with gap 0), all zeros left out."""
    start = (0,) * len(lists)
    heap, seen, out = [(0.0, start)], {start}, []
    while heap and len(out) <= n:
        total, choice = heapq.heappop(heap)
        out.append((total, choice))
        for i, c in enumerate(choice):
            if c < len(lists[i]):
                after = (*choice[:i], c + 1, *choice[i + 1 :])
                if after not in seen:
                    seen.add(after)
                    heapq.heappush(heap, (sum(lists[k][x - 1][0] for k, x in enumerate(after) if x), after))
    return [x for x in out if any(x[1])][:n]


def pieces(path: str) -> Pieces:
    if path not in _workers:
        _workers[path] = Pieces(path)
    return _workers[path]


SCHEMA = "doc_id long, n_ids long, ids binary, score double, gap_2 double, gap_3 double, decodes boolean, next array<struct<score: double, ids: binary>>"


def encode(docs: DataFrame, path: str, n_best: int = 3) -> DataFrame:
    """(doc_id, n_ids, ids, score, gap_2, gap_3, decodes, next): the best ids (little-endian 32-bit), its score, how far the second and third best
    segmentations fall behind (null where they aren't asked for), whether the ids decode to the text, and the second to last of the n best
    segmentations, by score. One pass, no shuffle."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        mark = SPACE.encode()
        for batch in batches:
            for block in bt.blocks(batch.column(1)):
                n = len(block)
                ids, first, score, gaps, others = own.encode_n(block.data, block.offsets, n_best)
                back, at = own.decode(ids, first)
                raw = block.data.tobytes()
                if mark in raw:
                    texts = [raw[a:b].replace(mark, b" ") for a, b in zip(block.offsets, block.offsets[1:])]
                    got = back.tobytes()
                    same = np.array([t == got[a:b] for t, a, b in zip(texts, at, at[1:])], bool)
                elif len(back) == len(block.data) and np.array_equal(at, block.offsets):
                    wrong = np.append(0, np.cumsum(back != block.data))
                    same = wrong[at[1:]] == wrong[at[:-1]]
                else:
                    got = back.tobytes()
                    same = np.array([raw[a:b] == got[c:d] for a, b, c, d in zip(block.offsets, block.offsets[1:], at, at[1:])], bool)
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((first * 4).astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                shown = np.hstack([gaps, np.full((n, 2), np.inf)])[:, :2]
                second, third = (pa.array(g, pa.float64(), mask=~np.isfinite(g)) for g in shown.T)
                upto = np.append(0, np.cumsum([len(x) for x in others])).astype(np.int32)
                behind = (score[:, None] - gaps)[np.isfinite(gaps)]
                listed = pa.StructArray.from_arrays([pa.array(behind, pa.float64()), pa.array([x for own_ in others for x in own_], pa.binary())], ["score", "ids"])
                nexts = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), listed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, n), pa.array(np.diff(first), pa.int64()), packed, pa.array(score, pa.float64()), second, third, pa.array(same), nexts], ["doc_id", "n_ids", "ids", "score", "gap_2", "gap_3", "decodes", "next"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(apply, SCHEMA)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), "score", "gap_2", "gap_3", "decodes", *(F.crc32(F.try_element_at("next", F.lit(k))["ids"]).alias(f"ids_{k + 1}_crc32") for k in (1, 2)))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode(tables.read(spark, sf_dir, "documents").select("doc_id", "text"), model_path()))
