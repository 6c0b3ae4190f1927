"""Title votes: against counting all pairs, against the SQL on odd rows, and by what they move."""

import random
import re
from collections import Counter

import duckdb
import pytest

from lektor.operators import matching
from lektor.plans import catalogue


def by_hand(left, right, stop=()):
    sets = {}
    for side, rows in enumerate((left, right)):
        for key, title in rows:
            sets.setdefault((side, key), set()).update(w for w in re.findall(r"[^\W\d_]{2,}", (title or "").lower()) if w not in stop)
    out = set()
    for (side, key), words in sets.items():
        shared = Counter({other: n for (s, other), more in sets.items() if s and not side and (n := len(words & more))})
        top = max(shared.values(), default=0)
        best = [other for other, n in shared.items() if n == top]
        if len(best) == 1:
            out.add((key, best[0], top))
    return out


@pytest.mark.parametrize("block_rows, block_chars", [(1 << 16, 1 << 25), (7, 1 << 25), (1 << 16, 150)])
def test_title_votes_count_all_pairs(spark, monkeypatch, block_rows, block_chars):
    monkeypatch.setattr(matching, "VOTE_ROWS", block_rows)
    monkeypatch.setattr(matching, "VOTE_CHARS", block_chars)
    draw = random.Random(5)
    words = [a + b for a in "bcdfgh" for b in ("ab", "éc", "и", "ed", "of")]
    title = lambda: " ".join(draw.choices(["the", "of", *words], [20, 10, *range(1, 31)], k=draw.randint(0, 9)))
    long = [chr(97 + k // 26 % 26) + chr(97 + k % 26) + "qz" for k in range(600)]
    left = [(f"l{k % 80}", title()) for k in range(90)] + [(None, "the beé"), ("none", None), ("long", " ".join(long[:500]))]
    right = [(k, title()) for k in range(60)] + [(3, title()), (None, "the gof"), (70, None), (71, " ".join(long[:400])), (72, " ".join(long[100:500])), (73, " ".join(long[:401]))]
    for stop in ([], ["the", "cab"]):
        got = matching.title_votes(spark.createDataFrame(left, "name string, title string"), spark.createDataFrame(right, "id int, title string"), "name", "id", stop)
        assert [(f.name, f.dataType.typeName()) for f in got.schema] == [("name", "string"), ("id", "integer"), ("shared", "long")]
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == by_hand(left, right, stop) and ("long", 73, 401) in rows


def test_title_votes_without_rows(spark):
    none, some = spark.createDataFrame([], "id int, title string"), spark.createDataFrame([(1, "one title")], "id int, title string")
    for a, b in ((none, some), (some, none), (none, none)):
        assert matching.title_votes(a.withColumnRenamed("id", "a"), b, "a", "id").collect() == []


def test_title_vote_odd_rows(spark, tmp_path):
    """Repeated and null ids, turns without text or number: as the SQL has them."""
    con = duckdb.connect()
    for name, columns, rows in (
        ("pages", "page_id bigint, html varchar", [(1, "<title>Alpha beta"), (1, "<title>alpha gamma</title>"), (2, "<title>zeta second"), (3, None), (4, "no title"), (None, "<title>delta the"), (None, "<title>delta"), (5, "<title>turn")]),
        ("conversations", "conv_id bigint, turn int, text varchar", [(1, 0, "alpha beta gamma"), (1, 1, "zeta"), (2, 0, "alpha beta"), (3, 0, None), (3, 1, "zeta second"), (4, None, "turn"), (None, 0, "the delta"), (5, 0, "")]),
    ):
        con.execute(f"create table {name} ({columns})")
        con.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
        con.execute(f"copy {name} to '{tmp_path}/{name}.parquet'")
    want = set(con.sql(catalogue.oracle_sql()["title_vote"]).fetchall())
    assert want == {(1, 1, 3), (2, 3, 2), (None, None, 2)}
    assert sorted(map(tuple, catalogue.queries()["title_vote"](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_title_votes_move_rows_not_pairs(spark):
    """500 x 500 titles that share five common words: 1.25 million rows of a join on words."""

    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    own = lambda k: "".join(chr(97 + int(c)) for c in f"{k:04d}")
    left, right = (spark.createDataFrame([(k, f"the same five common words {own(k)}") for k in range(500)], f"{key} int, title string") for key in ("a", "b"))
    before = written()
    rows = matching.title_votes(left, right, "a", "b").collect()
    assert sorted(map(tuple, rows)) == [(k, k, 6) for k in range(500)]
    assert 0 < written() - before < 20_000
