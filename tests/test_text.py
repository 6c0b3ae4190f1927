"""Literal pairs for the text scalars."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lektor.functions import text as T
from lektor.functions import udf
from lektor.operators import matching, segments, status
from lektor.plans import catalogue


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text, want", [("42", 42), ("۱۸", 18), (" 5 ", 5), ("xiv", 14), ("XC", 90), ("clix", 159), ("iiii", None), ("vx", None), ("12a", None), (" ", None)])
def test_question_number(spark, text, want):
    assert one(spark, text, T.question_number) == want


def test_digits_and_fold(spark):
    assert one(spark, "١٢۳", T.western_digits) == "123"
    assert one(spark, "تعليم", T.fold) == one(spark, "تعلیم", T.fold)
    assert one(spark, "ﬁne", lambda c: udf.nfkc(c)) == "fine"


def test_labels(spark):
    assert one(spark, "intro : abc", lambda c: T.starts_with_label(c, ["intro"]))
    assert not one(spark, "introduction to a very long sentence " * 4, lambda c: T.starts_with_label(c, ["introduction"]))


@pytest.mark.parametrize("text, want", [("Lesson-Plan-v2-Final", [2]), ("plan v1.2 of v3", [1, 2]), ("none", [])])
def test_version(spark, text, want):
    assert one(spark, text, T.version_key) == want


def test_durations(spark):
    assert one(spark, "1:45", T.seconds) == 105
    assert tuple(one(spark, "3-5 min", T.minutes_range)) == (3, 5)


def test_colours(spark):
    assert one(spark, "FFFF00", T.is_yellow) and not one(spark, "00FF00", T.is_yellow)
    assert one(spark, "808088", T.is_grey) and one(spark, "auto", T.is_grey) and not one(spark, "FF0000", T.is_grey)


def test_ratio_and_bound(spark):
    rows = spark.createDataFrame([("abcd", "abxd"), ("", ""), ("aa", "ab"), ("kitten", "sitting")], "a string, b string")
    for r in rows.select(udf.ratio(F.col("a"), F.col("b")).alias("r"), udf.ratio_bound(udf.letter_counts(F.col("a")), F.length("a"), udf.letter_counts(F.col("b")), F.length("b")).alias("m")).collect():
        assert r.r <= r.m + 1e-12


def test_similar_lines_keeps_all(spark):
    from difflib import SequenceMatcher

    base = ["the quick brown fox jumps over the lazy dog again", "a wholly different line about other matters", "short"]
    left = [(i, s) for i, s in enumerate(base)]
    right = [(i, s.replace("o", "0", 1)) for i, s in enumerate(base)] + [(9, base[0] + "!!")]
    got = matching.similar_lines(spark.createDataFrame(left, "a int, x string"), spark.createDataFrame(right, "b int, y string"), 0.9)
    want = {(a, b) for a, x in left for b, y in right if SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.9}
    assert {(r.a, r.b) for r in got.collect()} == want


def test_near_duplicate_at_any_length(spark, tmp_path):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 8))) for _ in range(60)]
    items = [" ".join(rng.choices(words, k=k)) for k in (1, 1, 2, 3, 8, 30, 90, 120, 300)] + ["x" * 272, "日本語 abc"]
    lines = list(items) + ["x" * 368, "x" * 369]
    for line in items:
        for share in (0.03, 0.08, 0.15, 0.3):
            lines.append("".join(rng.choice("abcxyz ") if rng.random() < share else ch for ch in line).strip())
    lines = [s for s in lines if s]
    spark.createDataFrame([(7, "\n".join(lines), "en", "a")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {(i, j): SequenceMatcher(None, x, y, autojunk=False).ratio() for i, x in enumerate(lines) for j, y in enumerate(items)}
    got = catalogue.near_duplicate(spark, str(tmp_path)).collect()
    assert {(r.idx, r.item_id): r.ratio for r in got} == {k: r for k, r in want.items() if r >= 0.85} and len(got) == sum(r >= 0.85 for r in want.values())
    assert (9, 9) in want and want[(len(items), 9)] == 0.85


def test_coverage_of_short_items_and_any_language(spark, tmp_path):
    texts = [("a b c d e f g h i", "it"), ("xa b c d ey\nabc", None), ("one two three four five sixth", "de"), (None, "fr"), ("", "it"), ("  lead a b ", "de")]
    items = ["abc", "b c d e", "one two three four five six", "a b c d e f g h", "nowhere", " a b", "e f g h i j k", None]
    docs = [(i, t, lang, "s") for i, (t, lang) in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("coverage_matrix", "coverage_gaps", "marks_locate"):
        got = catalogue.queries()[name](spark, str(tmp_path))
        want = con.sql(catalogue.oracle_sql()[name])
        assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_digits_of_whole_texts(spark, tmp_path):
    spark.createDataFrame([(0, "x" * 300 + "٣۴")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert catalogue.western_digits(spark, str(tmp_path)).first().digest == hashlib.md5(b"x" * 300 + b"34").hexdigest()


def test_quotes_of_whole_turns(spark, tmp_path):
    long_ = "some words of the material stand here and go on for long, " * 5
    docs = [(1, long_ + "the end of it", "en", "s")]
    turns = [(1, 0, long_ + "but this is invented"), (1, 1, "some words ... the end of it"), (1, 2, "some words [...left out] the end of it"), (1, 3, "short"), (9, 4, "no document for it"), (1, 5, None), (1, 6, long_.strip())]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.turn: r.kept for r in catalogue.verify_quotes(spark, str(tmp_path)).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: False, 5: False, 6: True}
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert {r[1]: r[2] for r in con.sql(catalogue.oracle_sql()["verify_quotes"]).fetchall()} == got


@pytest.mark.parametrize("statuses, want", [([("pass", False), ("na", False)], "pass"), ([("pass", True)], None), ([("fail", False), ("pass", False)], "fail"), ([("na", False)], "na"), ([("needs_review", False), ("pass", False)], None)])
def test_fold(spark, statuses, want):
    rows = spark.createDataFrame([("k", s, p) for s, p in statuses], "k string, status string, partial boolean")
    assert status.cells(rows, "k").first().status == want


def test_lesson_groups(spark):
    heads = [(0, i, v) for i, v in enumerate([1, 2, 1, 2, 2, 3])]
    got = segments.drop_groups(spark.createDataFrame(heads, "d int, i int, v int"), ["d"], ["i"], "v").groupBy("grp").count().orderBy("grp").collect()
    assert [r["count"] for r in got] == [2, 4]
