"""The operators against plain versions, with nulls, empty tables, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import cases
import numpy as np
import pytest

from lektor.llm import bytetext, fingerprints, main_text, mixing, near_copies, neighbours, pieces, quality, repeats, simple8b, suffix_sort, tables, token_files, toxicity

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows():
    return cases.awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return cases.frame(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return cases.frame(spark, [])


# 1


def test_mix(docs, rows):
    got = mixing.mix_counts(docs).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(cases.lowered_words(r[1]))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, fixed, total = {}, {}, 1.5 * sum(size.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        target = fixed | {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if target[s] > 2 * size[s]]
        if not over:
            break
        fixed |= {s: 2 * size[s] for s in over}
    taken = Counter()
    for r in got:
        source = None if r.key == "n" else r.key[1:]
        assert r.target == pytest.approx(target[source]) and r.source_size == size[source]
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    longest = max(len(cases.lowered_words(r[1])) for r in rows)
    for s in names:
        assert abs(taken[s] - target[s]) <= 2 * longest
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in got:
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +want


def test_mix_keeps_columns_of_any_name(docs):
    from pyspark.sql import functions as F

    clashing = ["_rows", "_id", "_copies", "_key", "_h", "_k", "_hash", "_copy", "row", "rows", "id", "h", "copies", "copy", "hash"]
    wide = docs
    for i, c in enumerate(clashing):
        wide = wide.withColumn(c, F.lit(i))
    out = mixing.mix(wide)
    assert out.columns == wide.columns
    plain = Counter(r.doc_id for r in mixing.mix(docs).collect())
    rows_ = out.collect()
    assert Counter(r.doc_id for r in rows_) == plain
    assert all([r[c] for c in clashing] == list(range(len(clashing))) for r in rows_)


def test_mix_of_nothing(nothing):
    assert mixing.mix_counts(nothing).count() == 0 and mixing.mix(nothing).count() == 0


# 2


def test_repeats(docs, rows):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.spans(docs).collect())
    want = sorted((r[0] if r[0] is not None else -1, *x) for r, x in zip(rows, cases.removed([r[1] for r in rows])))
    assert got == want


def test_repeats_by_chance(spark):
    rng = random.Random(5)
    for trial in range(3):
        parts = ["".join(rng.choices("ab c", k=rng.choice([40, 150, 199, 200, 201, 260]))) for _ in range(5)]
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(25)] + ["ab" * 200, "a" * 350]
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
        assert got == [(i, *x) for i, x in enumerate(cases.removed(texts))]


def test_repeats_of_hot_anchors(spark):
    """A common passage between ever different neighbours, split from the second text on, and all at once."""
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh ", k=170))
    ends = ["".join(rng.choices("xyz", k=60)) for _ in range(4)]
    texts = ["".join(rng.choices("xyz", k=rng.randint(0, 50))) + rng.choice(ends)[rng.randint(0, 59) :] + passage + rng.choice(ends)[: rng.randint(0, 60)] + "".join(rng.choices("xyz", k=rng.randint(0, 50))) for _ in range(120)]
    want = [(i, *x) for i, x in enumerate(cases.removed(texts))]
    assert any(w[2] for w in want) and not all(w[2] for w in want)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for hot in (2, 10**9):
        assert sorted(tuple(r) for r in repeats.spans(docs, hot).collect()) == want


def test_repeats_of_one_byte(spark):
    """Every position of such a text is an anchor, all with few contexts."""
    n = 1 << 20
    texts = ["a" * n, "b" * n + "c" + "ab" * 500, "z" * 199, "z" * 200]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (n, n, 1), 1: (n + 1001, n + 1000, 2), 2: (199, 0, 0), 3: (200, 0, 0)}


def test_least_between():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 200):
        values = rng.integers(0, 50, n)
        lo = rng.integers(0, n, 100)
        hi = np.minimum(n - 1, lo + rng.integers(0, n, 100))
        assert repeats._least_between(repeats._minima(values), lo, hi).tolist() == [values[a : b + 1].min() for a, b in zip(lo, hi)]


def test_remove_keeps_columns(docs, rows, nothing):
    out = repeats.remove(docs)
    assert out.columns == docs.columns
    got = {(r.doc_id, r.key, r.t, r.k, r.slot) for r in out.collect()}
    assert got == {(r[0], r[5], r[6], r[7], r[8]) for r in rows}
    assert repeats.remove(nothing).count() == 0 and repeats.spans(nothing).count() == 0


def test_deep_shallow_sort():
    rng = random.Random(3)
    for _ in range(50):
        base = [bytes(rng.choice(b"ab\0") for _ in range(60)) for _ in range(3)]
        texts = [(rng.choice(base)[: rng.randint(0, 60)] + bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 30))))[:60] for _ in range(rng.randint(1, 40))]
        group = np.array(sorted(rng.randint(0, 3) for _ in texts))
        table, length = np.zeros((len(texts), 60), np.uint8), np.array([len(s) for s in texts])
        for i, s in enumerate(texts):
            table[i, : len(s)] = list(s)
        order = suffix_sort.sort(table, length, group)
        assert [(group[i], texts[i]) for i in order] == sorted(zip(group, texts))


# 4


def test_near_copies(docs, rows):
    got = near_copies.link(docs).collect()
    assert len(got) == len(rows)
    want = cases.near_components(rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
    size = {r[0]: len(cases.shingle_set(r[1])) for r in rows}
    assert all(r.n_shingles == size[r.doc_id] for r in got)


def test_near_copies_chains(spark):
    """Chains of ever different texts, where the ends aren't alike, and groups without a centre."""
    rng = random.Random(9)
    texts = []
    for _ in range(6):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([20, 60, 200]))]
        for _ in range(8):
            texts.append(" ".join(w))
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in near_copies.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == cases.near_components(rows)


def test_near_copies_of_hot_shingles(spark):
    """Groups of near copies and common shingles, split into many blocks and not at all."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:20] + [f"u{rng.randrange(10**6)}" for _ in range(20)]) for _ in range(30)] + [" ".join(base[k : k + 8]) for k in range(20)] * 2
    rows = list(enumerate(texts))
    want = cases.near_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for hot in (2, 7, 10**6):
        assert {r.doc_id: r.component_id for r in near_copies.link(docs, hot).collect()} == want


def test_keep_one_of_a_shared_id(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", "a"), (1, "quite another text that is here", "b"), (1, "one two three four five six", "c"), (2, "x y", "d")], "doc_id long, text string, row string")
    first, again = (sorted(map(tuple, near_copies.keep_one(docs.repartition(n)).collect())) for n in (1, 4))
    assert first == again and [r[0] for r in first] == [1, 2]


def test_keep_one(docs, rows, nothing):
    kept = near_copies.keep_one(docs)
    assert set(kept.columns) == set(docs.columns)
    want = set(cases.near_components(rows).values()) | {None}
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(-1 if x is None else x for x in want)
    assert near_copies.link(nothing).count() == 0


def test_prefix_shares_enough():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 60)
        df = np.sort(np.array([rng.randint(2, 50) for _ in range(rng.randint(near_copies.need(n), n))]))
        l, p = near_copies.prefix(n, df)
        assert 1 <= l <= max(1, near_copies.need(n)) and p <= len(df)
        assert len(df) - p <= near_copies.need(n) - l  # what is left out can't hold all but l - 1 of the shared ones


# 3 and 10


def test_classifiers(spark, docs, rows, nothing):
    table, labels = tables.read(spark, SMALL, "documents"), tables.read(spark, SMALL, "labels")
    model = quality.train(table, labels)
    y = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    got = {r.doc_id: r.score for r in quality.score(table.select("doc_id", "text", "n_chars"), model).collect()}
    held = [d for d in y if zlib.crc32(str(d).encode()) % 4 == 2]
    assert np.mean([(got[d] >= 0.7) == (y[d][0] == 1) for d in held]) >= 0.9
    scored = quality.score(docs, model)
    assert scored.count() == len(rows) and set(scored.columns) == set(docs.columns)
    assert all(0 <= r.score <= 1 for r in scored.collect())
    assert quality.score(nothing, model).count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns
    toxic = toxicity.train(table, labels)
    scored = {r.doc_id: r for r in toxicity.score(table, toxic).collect()}
    assert np.mean([(scored[d].p_toxic >= 0.5) == (y[d][1] == 1) for d in held]) >= 0.9  # rows never learned from
    words = Counter(w for d, r in ((r.doc_id, r) for r in table.collect()) if d in y and y[d][1] and d not in held for w in set(cases.lowered_words(r.text)))
    plain = Counter(w for r in table.collect() if r.doc_id in y and not y[r.doc_id][1] and r.doc_id not in held for w in set(cases.lowered_words(r.text)))
    telling = {w for w, n in words.items() if n >= 3 and n > 20 * plain[w]}
    counts = {r.doc_id: sum(w in telling for w in cases.lowered_words(r.text)) for r in table.collect()}
    many, none = ([scored[d].severity for d in scored if test(counts[d])] for test in (lambda n: n >= 3, lambda n: n == 0))
    assert telling and np.mean(many) > 0.8 and np.mean(none) < 0.2  # a plain count of telling words agrees
    out = toxicity.score(docs, toxic).collect()
    assert len(out) == len(rows) and all(0 <= r.severity <= 2 for r in out)
    assert toxicity.score(nothing, toxic).count() == 0


def test_no_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    assert {r.severity for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.0}


def test_labels_of_repeated_ids(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i} of some words", 20) for i in range(200)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(7)] * 3 + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    models = [quality.train(docs.repartition(n), labels, held_out=None) for n in (1, 4)]
    assert (models[0].linear == models[1].linear).all()
    assert toxicity.score(docs, toxicity.train(docs, labels, held_out=None)).count() == 200


def test_tails_of_an_ordinal():
    """The thresholds share the weights; the severity is the sum of the tails."""
    model = toxicity.Ordinal(np.array([0.5, -1.0, 2.0, 0.0]), np.array([1.0, 2.5]))
    got = model.tails(np.array([0, 2, 2, 3]), np.array([0, 2, 1]), np.array([1, 3, 1]))
    plain = [[1 / (1 + np.exp(t - s)) for t in (1.0, 2.5)] for s in (0.5 * 1 + 2.0 * 2, 0.0, -1.0)]
    assert got == pytest.approx(np.array(plain))


def test_scores_of_texts_by_hand(spark):
    """The machine's score of a table, against the double sum over all pairs of features."""
    rng = np.random.default_rng(5)
    bits, rank = 6, 3
    size = (1 << bits) + len(quality.features.STRUCTURE)
    model = quality.Machine(bits, 0.2, rng.normal(size=size), rng.normal(size=(size, rank)) / 3, np.zeros(size - (1 << bits)), np.ones(size - (1 << bits)), 0.1)
    texts = ["some words here, some more", "UPPER and 123!", "", None, "x " * 50]
    docs = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    import pyarrow as pa

    block = next(bytetext.blocks(pa.array(texts)))
    first, bucket, count, structure = quality.features.rows(block, bits, np.array([np.nan if t is None else float(len(t)) for t in texts]))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for d in range(len(texts)):
        b, c = bucket[first[d] : first[d + 1]], count[first[d] : first[d + 1]]
        x = np.zeros(size)
        x[b] = np.sqrt(c / c.sum()) if len(c) else 0
        x[1 << bits :] = np.clip(structure[d], -8, 8)
        raw = 0.2 + 0.1 + x @ model.linear + sum(x[i] * x[j] * (model.factors[i] @ model.factors[j]) for i in range(size) for j in range(i) if x[i] and x[j])
        assert got[d] == pytest.approx(1 / (1 + np.exp(-raw)))


def test_sum_of_squares():
    rng = np.random.default_rng(0)
    model = quality.Machine(3, 0.1, rng.normal(size=8 + 12), rng.normal(size=(20, 4)), np.zeros(12), np.ones(12))
    x, s = rng.random(3), rng.random((1, 12))
    full = np.zeros(20)
    full[[1, 4, 6]], full[8:] = x, s
    plain = 0.1 + full @ model.linear + sum(full[i] * full[j] * (model.factors[i] @ model.factors[j]) for i in range(20) for j in range(i))
    assert model.raw(np.array([0, 3]), np.array([1, 4, 6]), x, s)[0][0] == pytest.approx(plain)


# 5


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(pieces.model_path())


@pytest.mark.parametrize("text", ["▁hello", "▁théâ", "▁aaab", "\n", "▁▁x", "日本語☃", "a.b,"])
def test_n_best(vocabulary, text):
    out = []

    def go(at, score, ids):
        if at == len(text):
            out.append((score, ids))
            return
        for end in range(at + 1, min(len(text), at + vocabulary.longest) + 1):
            if found := vocabulary.arcs.get(text[at:end]):
                go(end, score + found[0], ids + [found[1]])
        if text[at] not in vocabulary.arcs:
            go(at + 1, score + vocabulary.unknown, ids + [vocabulary.byte[b] for b in text[at].encode()])

    go(0, 0.0, [])
    out.sort(key=lambda x: -x[0])
    assert [s for s, _ in vocabulary.n_best(text, 5)] == pytest.approx([s for s, _ in out[:5]])


def test_whole_texts(vocabulary, rows):
    for text in [r[1] for r in rows if r[1] and len(r[1]) < 400] + ["two  spaces\n\nend. ", "x"]:
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, first, score, gaps = vocabulary.encode(raw, np.array([0, len(raw)]))
        best = vocabulary.text_n_best(text, 3)
        assert score[0] == pytest.approx(best[0][0])
        assert [g for g in gaps[0] if np.isfinite(g)] == pytest.approx([best[0][0] - s for s, _ in best[1:]], abs=1e-3)
        back, _ = vocabulary.decode(ids, first)
        assert back.tobytes().decode() == text


def test_pieces(docs, rows, nothing):
    got = pieces.digest(pieces.encode(docs, pieces.model_path())).collect()
    assert len(got) == len(rows) and all(r.decodes for r in got)
    assert {r.n_ids for r in got if r.doc_id in (0, 3)} == {0}
    assert pieces.encode(nothing, pieces.model_path()).count() == 0


def test_n_best_of_documents(spark, vocabulary):
    texts = ["", None, "x", "hello there, the other day", "two  spaces\n\nend. ", "aaa aaa aaa", "日本語☃ and théâtre", "again and again and again " * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n in (1, 2, 3, 6):
        for r in pieces.encode(docs, pieces.model_path(), n).collect():
            text = texts[r.doc_id] or ""
            want = vocabulary.text_n_best(text, n)
            lists = [np.frombuffer(x, "<u4") for x in [r.ids, *(y.ids for y in r.next)]]
            assert [r.score, *(y.score for y in r.next)] == pytest.approx([s for s, _ in want], abs=1e-3)
            assert len({x.tobytes() for x in lists}) == len(lists) == len(want)
            assert all(vocabulary.decode(x, np.array([0, len(x)]))[0].tobytes().decode() == text for x in lists)
            ties = [round(s, 3) for s, _ in vocabulary.text_n_best(text, n + 1)]
            if len(set(ties)) == len(ties):
                assert [x.tolist() for x in lists] == [ids for _, ids in want]


# 6


def plain_fingerprint(text):
    """Anchors by the definition, one k-mer after the other."""
    import regex
    import xxhash

    def chained(*values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(8, "little", signed=True), seed)
        return seed - (1 << 64) if seed >> 63 else seed

    k, s = fingerprints.K, fingerprints.S
    h = [chained(u.group().encode()) for u in regex.finditer(fingerprints.UNIT.replace("\\x{20000}-\\x{3FFFF}", "\\U00020000-\\U0003FFFF"), text)]
    if 0 < len(h) < k:
        return [chained(" ".join(f"{x & (1 << 64) - 1:X}" for x in h).encode()) & 0xFFFFFFFF]
    m = [chained(*h[i : i + s]) for i in range(len(h) - s + 1)]
    every, out, w = [], [], k - s + 1
    for i in range(len(h) - k + 1):
        kmer = chained(m[i], m[i + 1], m[i + 3]) & 0xFFFFFFFF
        every.append(kmer)
        if min(m[i : i + w]) in (m[i], m[i + w - 1]):
            out.append(kmer)
    return out or ([min(every)] if every else [])


def plain_likeness(a, b):
    a, b = ({*zip(x, [*x[1:], 0])} for x in (a, b))
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_fingerprints(spark, rows, tmp_path):
    """The whole query against a plain version: nulls, ties of doc_id, scripts without spaces, long tokens."""
    rng = random.Random(6)
    han = "".join(rng.choices("一二三四五六七八九十天地人日月山水火木金土", k=400))
    token = "".join(rng.choices("bcdfgBCDaeX0/+", k=900))
    more = [han, han[:200] + "新" + han[200:], token, token[:300] + "Q" + token[300:], "word " + han[:50] + "end สวัสดีครับ", "\U00020000\U00020001 x", "q" * 500, "é" * 100]
    own = [r for r in rows if r[0] is not None][:-1] + [(1000 + i, t, *[None] * 10) for i, t in enumerate(more)] + [(None, t, *[None] * 10) for t in ("no id", "none either", "nor here " * 9)]
    own += [(55, f"shared id {i} " * (i + 1), *[None] * 10) for i in range(30)]
    cases.frame(spark, own).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, fingerprints.op6_fingerprints(spark, str(tmp_path)).collect()), key=repr)
    tie = {r.text: r.h for r in spark.createDataFrame([(r[1] or "",) for r in own], "text string").selectExpr("text", "xxhash64(text) h").collect()}
    order = sorted(own, key=lambda r: (r[0] is None, -(r[0] or 0), -tie[r[1] or ""]))
    want = []
    show = lambda a: "".join(f"{x:08X}" for x in a)
    for here, following in zip(order, order[1:] + order[:1]):
        text, other = here[1] or "", following[1] or ""
        edited = text[: len(text) - len(text) // 3] + other[: len(text) // 3]
        a, e, n = map(plain_fingerprint, (text, edited, other))
        want.append((here[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(e), plain_likeness(a, e), plain_likeness(a, n)))
    assert got == sorted(want, key=repr)
    assert all(w[5] > 0.45 for w in want if len({w[3][k : k + 8] for k in range(0, len(w[3]), 8)}) > 60)
    print_ = {t: plain_fingerprint(t) for t in more[:4]}
    assert plain_likeness(print_[more[0]], print_[more[1]]) > 0.95 and plain_likeness(print_[more[2]], print_[more[3]]) > 0.95  # one character put in


def test_fingerprints_of_short_texts(spark):
    from pyspark.sql import functions as F

    texts = [(n, " ".join(f"u{(n * 1000 + v * 10 + k) * 7919 % 10007}" for k in range(n))) for n in range(1, 9) for v in range(20)]
    rows = spark.createDataFrame(texts, "n int, text string").select("n", fingerprints.anchors(F.col("text")).alias("a"))
    like = lambda a, b: fingerprints.likeness(fingerprints.links(a), fingerprints.links(b))
    got = rows.select("n", "a", like(F.col("a"), fingerprints.anchors(F.lit("other words"))).alias("other"), like(F.col("a"), F.col("a")).alias("same")).collect()
    assert all(r.a and r.other == 0 and r.same == 1 for r in got)
    assert len({tuple(r.a) for r in got}) == len({t for _, t in texts})


def test_fingerprints_of_nothing(spark, nothing, tmp_path):
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    assert fingerprints.op6_fingerprints(spark, str(tmp_path)).count() == 0


# 7


def test_neighbours(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=16).astype(float).tolist()) for i in range(200)]
    vectors += [(200 + i, vectors[0][1]) for i in range(30)] + [vectors[5], (300, None), (301, [0.0] * 16), (302, [None] + [1.0] * 15), (303, [float("nan")] * 16), (304, [float("inf")] * 16), (None, [1.0] * 16), (320, []), (340, [1.0, 2.0])]
    got = neighbours.nearest(spark.createDataFrame(vectors, "vec_id long, vec array<double>"), F.col("vec_id") % 20 == 0).collect()
    ok = {i: np.array(v) for i, v in vectors if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    hits = total = 0
    for q in [i for i in ok if i % 20 == 0]:
        scores = sorted(((-sum(x * y for x, y in zip(v.tolist(), ok[q].tolist())), i) for i, v in ok.items() if i != q))[:20]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        hits += len({m[1] for m in mine} & {i for _, i in scores})
        total += 20
    assert hits / total >= 0.95
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, vec array<float>"), F.col("vec_id") % 20 == 0).count() == 0


# 8


def test_simple8b():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1000, 70000):
        for high in (2, 50000, 2**63):
            ids = rng.integers(0, high, n, dtype=np.uint64)
            assert (simple8b.decode(simple8b.encode(ids), n) == ids).all()
    ids = np.zeros(1000, np.uint64)
    ids[[0, 500, 501, 999]] = 2**64 - 1
    assert (simple8b.decode(simple8b.encode(ids), 1000) == ids).all()


def test_token_files(spark, docs, rows, nothing, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    extra = [(9001, "<|endoftext|> <|EndOfText|> Don't I'LL 's", *[None] * 10), (9002, "ΑΣ Ǆ é ́x İ 12,5 x", *[None] * 10)]
    table = cases.frame(spark, rows + extra)
    folder = str(tmp_path / "out")
    got = token_files.read(token_files.write(table, path, folder, 3), folder).collect()
    tokenizer = Tokenizer.from_file(path)
    want = {}
    for r in rows + extra:
        want[r[0]] = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]
    got.sort(key=lambda r: r.start)
    assert [(-1 if r.doc_id is None else r.doc_id) for r in got] == sorted(-1 if r[0] is None else r[0] for r in rows + extra)
    start = 0
    for r in got:
        assert r.start == start and np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id]
        start += r.n_tokens
    empty = str(tmp_path / "none")
    assert token_files.read(token_files.write(nothing, path, empty), empty).count() == 0


# 9


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><div class=logo>My Site</div></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies. <a href="#">OK</a></p></div><div class="ad">Buy now.</div>
<article><h1>Head &eacute;</h1><p><b>First</b>  para&#8217;s text &lt;here&gt;.<br>More<p>Second one<ul><li>Item one<li>Item two</ul></article>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/x">Link one</a></li><li><a href="/y">Link two</a></li></ul></aside>
<div class="comments"><h3>Comments</h3><div class="comment"><b>Bob</b><p>Nice article, thanks for it.</p></div></div>
<form class="newsletter"><p>Subscribe to us.</p><input><button>Go</button></form><footer>&copy; site</footer></body></html>"""


def test_main_text(spark, nothing):
    model = main_text.trained()
    assert model.text(PAGE) == "Head é First para’s text <here>. More Second one Item one Item two"
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 1), (3, "u", "", 1), (4, "u", "<div><script>x", 1)], "page_id long, url string, html string, text int")
    got = main_text.extract(pages, model).collect()
    assert [r.n_chars for r in got] == [len(r.text) for r in got] and len(got) == 5
    assert {r.text for r in got if r.page_id > 1} == {""}
    assert main_text.extract(pages.limit(0), model).count() == 0


def test_marginals_by_enumeration():
    import itertools
    import math

    model = main_text.trained()
    page = main_text.parse("<div><p>one two</p><article><h1>three</h1>four</article></div>")
    n = len(page.parent)
    total, yes = 0.0, [0.0] * n
    for states in itertools.product((0, 1), repeat=n):
        score = sum(s * sum(model.weight.get(f, 0.0) for f in page.features[v]) for v, s in enumerate(states))
        score += sum(model.edge[page.text[v] is not None][2 * states[page.parent[v]] + states[v]] for v in range(1, n))
        w = math.exp(score)
        total += w
        for v, s in enumerate(states):
            yes[v] += w * s
    odds = model.marginals(page)[0]
    for v in range(n):
        assert 1 / (1 + math.exp(-odds[v])) == pytest.approx(yes[v] / total, abs=1e-6)


def test_blocks_never_cut(rows):
    import pyarrow as pa

    texts = pa.array([r[1] for r in rows]).slice(3)
    got = [b.data[b.offsets[i] : b.offsets[i + 1]].tobytes().decode() for b in bytetext.blocks(texts, 1000) for i in range(len(b))]
    assert got == [r[1] or "" for r in rows][3:]
