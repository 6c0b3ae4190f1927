"""Small tables with every awkward case, and plain versions to hold the operators against."""

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, t int, k double, slot int, score string, size string, part int"


def awkward(n=40, seed=1):
    """Nulls, empty and blank texts, one very long text, exact and near copies, shared passages, repeated rows, clashing columns."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstuv", k=rng.randint(1, 9))) for _ in range(400)] + ["é", "ñandú", "日本語", "A.", "x,", "The", "THE"]
    words = lambda m: " ".join(rng.choices(vocabulary, k=m))
    passage = words(60)
    base = words(120)
    texts = [None, "", "   \n\t", "one", "One", "two words", "a b c d", words(4000), "x" * 3000, passage, words(30) + " " + passage + " " + words(30), words(10) + "\n" + passage, "aaa " * 300, base, base, base.upper()]
    for _ in range(4):
        w = base.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    w = base.split(" ")
    for i in range(0, len(w), 9):
        w[i] = "far"
    texts.append(" ".join(w))
    while len(texts) < n:
        texts.append(words(rng.randint(1, 200)))
    rows = []
    for i, text in enumerate(texts):
        source = [None, "a", "b", "Z", ""][i % 5]
        rows.append((i * 3, text, None if i % 7 == 0 else "en", source, None if text is None or i % 4 == 0 else len(text), "x", 1, 0.5, 2, "s", "z", 3))
    rows.append(rows[-1])
    rows.append((None, "no id at all here, just text", None, None, None, None, None, None, None, None, None, None))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def lowered_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text):
    w = lowered_words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_components(rows):
    """{doc_id: component}, by comparing all pairs."""
    sets = [(r[0], shingle_set(r[1])) for r in rows if r[0] is not None]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(sets)}


def removed(texts, span=200):
    """(n_bytes, n_removed, n_spans, sha of what is kept) of each text, by looking at every string."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for p in range(len(b) - span + 1):
            seen[b[p : p + span]] = seen.get(b[p : p + span], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if seen[b[p : p + span]] > 1:
                gone[p : p + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out
