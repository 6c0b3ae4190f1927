"""The pipeline, stage by stage, against plain versions of each on its own input."""

import hashlib
from collections import Counter

import cases
import numpy as np
import pytest

import corpus_pipeline
from lektor.llm import mixing, tables

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = tables.read(spark, DATA, "documents")
    before = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        path = tables.new_path(spark, "test-stage")
        out.write.parquet(path)
        after = spark.read.parquet(path)
        rows = after.collect()
        if k < 4:
            assert after.columns == docs.columns
        ids = [r.doc_id for r in rows]
        if name == "quality":
            assert set(ids) <= {r.doc_id for r in before} and len(ids) >= 0.7 * len(before)
        elif name == "near_copies":
            assert set(ids) == set(cases.near_components([(r.doc_id, r.text) for r in before]).values()) and len(ids) == len(set(ids))
        elif name == "repeats":
            want = {r.doc_id: x for r, x in zip(before, cases.removed([r.text for r in before]))}
            assert sorted(ids) == sorted(want)
            for r in rows:
                n, gone, spans, sha = want[r.doc_id]
                kept = (r.text or "").encode()
                assert n - gone - 3 * (spans + 1) <= len(kept) <= n - gone  # a character that a cut splits goes whole
                assert len(kept) < n - gone or hashlib.sha256(kept).hexdigest() == sha
        elif name == "mixture":
            assert set(ids) <= {r.doc_id for r in before}
            assert len(ids) == sum(r.copies for r in mixing.mix_counts(docs).collect())
        else:
            assert sorted(ids) == sorted(r.doc_id for r in before) and all(r.decodes for r in rows)
        docs, before = after, rows


def test_run(spark):
    """run() against a plain version of the stages behind the classifier, which test_stages holds to its scores."""
    from sentencepiece import SentencePieceProcessor

    docs = tables.read(spark, DATA, "documents")
    good = corpus_pipeline.STAGES[0][1](spark, docs, DATA).collect()
    one = set(cases.near_components([(r.doc_id, r.text) for r in good]).values())
    left = [r for r in good if r.doc_id in one]
    kept = {r.doc_id: x for r, x in zip(left, cases.removed([r.text for r in left]))}
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in got} <= one
    taken = Counter(r.doc_id for r in got)
    assert max(taken.values()) <= 2
    sizes, words = Counter(), Counter()
    spelled = SentencePieceProcessor(model_file=corpus_pipeline.pieces.model_path())
    text = {}
    for r in got:
        assert r.decodes
        text[r.doc_id] = spelled.decode(np.frombuffer(r.ids, "<u4").tolist())
        n, gone, spans, _ = kept[r.doc_id]
        assert n - gone - 3 * (spans + 1) <= len(text[r.doc_id].encode()) <= n - gone
    source = {r.doc_id: r.source for r in left}
    whole = {r.doc_id: r for r in good}
    for d, n in taken.items():
        words[source[d]] += n * len(cases.lowered_words(text[d]))
    for r in left:
        n, gone, _, _ = kept[r.doc_id]
        sizes[r.source] += len(cases.lowered_words(r.text)) if not gone else len(cases.lowered_words(text.get(r.doc_id, "")))
    longest = max(len(cases.lowered_words(r.text)) for r in whole.values())
    assert all(words[s] <= 2 * sizes[s] + 2 * longest for s in sizes)
    assert sum(words.values()) > sum(sizes.values())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_names(name):
    assert name in dict(corpus_pipeline.STAGES) and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "mixture", "pieces"]
