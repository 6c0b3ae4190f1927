"""Joins by content: coverage, containment, title votes, quotes, reconciling, near-duplicates, and BM25 ranking."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from lektor.functions import similar, votes
from lektor.functions import text as T
from lektor.sources.tables import spread

RIGHT_BLOCK, SHORT_BLOCK, VOTE_ROWS, VOTE_CHARS = 10_000, 1_000, 1 << 16, 1 << 25


def contains_pairs(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str) -> DataFrame:
    """Pairs in which the document holds the item's whole text.

    Wherever an item of seven words or more stands in a text, its words two to six stand there as whole words, so the join hashes on them, without
    the texts (Spark broadcasts the items' hashes where their size is known to be small); texts come back for the pairs that are left.
    Shorter items go to every task in blocks of SHORT_BLOCK; each text is read once a block. An empty item is in every text.
    """
    words = F.split(F.col("text"), r"\s+")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(F.col("_w"), i, F.lit(5))))
    a = docs.select(doc_key, words.alias("_w")).select(doc_key, F.explode(F.array_distinct(grams)).alias("_g"))
    needles = items.select(item_key, F.col("text").alias("_needle"), words.alias("_v")).where("_needle is not null")
    b = needles.where(F.size("_v") >= 7).select(item_key, F.xxhash64(F.slice(F.col("_v"), F.lit(2), F.lit(5))).alias("_g"))
    pairs = a.join(b, "_g").select(doc_key, item_key).distinct()
    found = pairs.join(docs.select(doc_key, F.col("text").alias("_hay")), doc_key).join(needles.select(item_key, "_needle"), item_key).where(F.col("_hay").contains(F.col("_needle"))).select(doc_key, item_key)
    short, block = needles.where(F.size("_v") < 7).select(item_key, "_needle"), []
    for row in short.toLocalIterator():
        block.append(row)
        if len(block) == SHORT_BLOCK:
            found, block = found.unionAll(_short_pairs(docs, doc_key, block, short)), []
    if block:
        found = found.unionAll(_short_pairs(docs, doc_key, block, short))
    return found.distinct()


def _short_pairs(docs: DataFrame, doc_key: str, block: list, short: DataFrame) -> DataFrame:
    rows = docs.sparkSession.createDataFrame(block, short.schema)
    return docs.join(F.broadcast(rows), F.col("text").contains(F.col("_needle"))).select(doc_key, short.columns[0])


def gaps(items: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    return items.join(hits.select(key).distinct(), key, "left_anti")


def title_votes(left: DataFrame, right: DataFrame, left_key: str, right_key: str, stop: list[str] = ()) -> DataFrame:
    """The right row that shares the most title words with each left row, where that is unique. ``stop`` words don't count; rows of one key count as one.

    The right side is dealt in blocks of at most about VOTE_ROWS rows and VOTE_CHARS characters, the left side goes to every block (and to so many
    tasks a block that all cores have work), and only the best of a block comes back: what is moved follows the rows, not the pairs with a common word.
    """
    words = lambda c: F.array_except(F.array_distinct(T.tokens(F.col(c))), F.array(*map(F.lit, stop))) if stop else F.array_distinct(T.tokens(F.col(c)))
    sets = lambda rows, key, union: rows.select(F.col(key).alias("k"), words("title").alias("w")).groupBy("k").agg(union.alias("w")).where(F.size("w") > 0)
    union = F.flatten(F.collect_set("w"))
    a, b = sets(left, left_key, F.array_sort(F.array_distinct(union))), sets(right, right_key, union)  # a block counts a word of a row once
    size = right.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("title")).alias("chars")).first()
    blocks = max(1, math.ceil(size.n / VOTE_ROWS), math.ceil((size.chars or 0) / VOTE_CHARS))
    shares = math.ceil(left.sparkSession.sparkContext.defaultParallelism / blocks)
    part = lambda m: F.pmod(F.xxhash64("k"), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    none = lambda rows: F.lit(None).cast(rows.schema["k"].dataType)
    rows = b.select("*", part(blocks).alias("b"), every(shares).alias("s")).select("b", "s", F.lit(0).alias("kind"), none(a).alias("_l"), F.col("k").alias("_r"), "w")
    asked = a.select("*", every(blocks).alias("b"), part(shares).alias("s")).select("b", "s", F.lit(1).alias("kind"), F.col("k").alias("_l"), none(b).alias("_r"), "w")
    dealt = rows.unionByName(asked).select((F.col("b") * shares + F.col("s")).cast("int").alias("cell"), "kind", "_l", "_r", "w")
    dealt = dealt.repartitionById(blocks * shares, F.col("cell")).sortWithinPartitions("cell", "kind")
    found = dealt.mapInArrow(votes.scan, StructType([StructField("_l", a.schema["k"].dataType), StructField("_r", b.schema["k"].dataType), StructField("ties", LongType()), StructField("shared", LongType())]))
    tops = found.repartition("_l").groupBy("_l", "shared").agg(F.sum("ties").alias("ties"), F.first("_r").alias("_r")).groupBy("_l").agg(F.max_by(F.struct("ties", "_r"), "shared").alias("m"), F.max("shared").alias("shared"))
    return tops.where("m.ties = 1").select(F.col("_l").alias(left_key), F.col("m._r").alias(right_key), "shared")


def similar_lines(left: DataFrame, right: DataFrame, least: float, junk: bool = False) -> DataFrame:
    """Pairs (a, b, ratio) of lines at or above a Ratcliff-Obershelp ratio. ``left`` has (a, x), ``right`` (b, y); null lines are in no pair.

    Lines of every length take part. The right side goes to the workers in blocks of RIGHT_BLOCK lines, one pass over the left side each; upper
    bounds of the ratio (lengths, letters, neighbouring letters, longest common subsequence) clear most pairs before the exact ratio.
    """
    spark, schema = left.sparkSession, StructType([StructField("a", left.schema["a"].dataType), StructField("b", right.schema["b"].dataType), StructField("ratio", DoubleType())])
    x = spread(left.where("x is not null").select("a", "x"))
    found, block = [], []

    def scan() -> DataFrame:
        lines = similar.Lines([r.y for r in block], least, junk)
        keys, shared = [r.b for r in block], spark.sparkContext.broadcast(lines)
        numbers = spark.createDataFrame(list(enumerate(keys)), StructType([StructField("_j", IntegerType()), StructField("b", right.schema["b"].dataType)]))
        shortest, longest = lines.spans()
        hits = x.where(F.length("x").between(shortest, longest)).mapInArrow(similar.scan(shared), StructType([schema["a"], StructField("_j", IntegerType()), schema["ratio"]]))
        return hits.join(F.broadcast(numbers), "_j").select("a", "b", "ratio")

    for row in right.where("y is not null").select("b", "y").toLocalIterator():
        block.append(row)
        if len(block) == RIGHT_BLOCK:
            found.append(scan())
            block = []
    if block:
        found.append(scan())
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def terms(docs: DataFrame, key: str) -> DataFrame:
    """(key, term, f, len): term frequencies and document length."""
    words = spread(docs.select(key, "text")).select(key, T.tokens(F.col("text")).alias("t"))
    return words.select(key, F.size("t").alias("len"), F.explode("t").alias("term")).groupBy(key, "len", "term").agg(F.count(F.lit(1)).alias("f"))


def document_frequency(docs: DataFrame, key: str) -> DataFrame:
    return terms(docs, key).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25(docs: DataFrame, queries: DataFrame, doc_key: str, query_key: str, k: int, digits: int = 6) -> DataFrame:
    """The k best documents of each query: idf = ln(1 + (N - df + 0.5) / (df + 0.5)), score = sum idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len / avg)).

    Only terms that some query asks for leave the documents' words. Repeated query words count again; scores are rounded to ``digits``,
    ties go by document.
    """
    asked = queries.select(query_key, F.explode(T.tokens(F.col("text"))).alias("term")).groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("q"))
    docs = spread(docs.select(doc_key, "text"))
    words = docs.select(doc_key, T.tokens(F.col("text")).alias("t")).select(doc_key, F.size("t").alias("len"), F.explode("t").alias("term"))
    tf = words.join(asked.select("term").distinct(), "term", "left_semi").groupBy(doc_key, "len", "term").agg(F.count(F.lit(1)).alias("f"))
    size = docs.select(F.regexp_count(F.lower("text"), F.lit(T.TOKEN)).alias("len")).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hits = tf.join(asked.join(df, "term"), "term").crossJoin(F.broadcast(size))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("q") * idf * F.col("f") * 2.5 / (F.col("f") + 1.5 * (0.25 + 0.75 * F.col("len") / F.col("avg")))
    scored = hits.groupBy(query_key, doc_key).agg(F.round(F.sum(part), digits).alias("score"))
    w = Window.partitionBy(query_key).orderBy(F.col("score").desc(), doc_key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def passages(docs: DataFrame, queries: DataFrame, doc_key: str, query_key: str, k: int, longest: int) -> DataFrame:
    """(query, rank, document, passage): the first ``longest`` characters of each query's best documents, as material for a judgement."""
    best = bm25(docs, queries, doc_key, query_key, k)
    return best.join(docs.select(doc_key, F.left(F.trim("text"), F.lit(longest)).alias("passage")), doc_key).select(query_key, "rank", doc_key, "passage")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], prefer: Column) -> DataFrame:
    """Full outer join of two readings (value_l, value_r); ``prefer`` says when the left one wins."""
    both = left.join(right, keys, "full")
    source = F.when(F.col("value_l").isNotNull() & (prefer | F.col("value_r").isNull()), "left").when(F.col("value_r").isNotNull(), "right")
    return both.withColumn("source", source).withColumn("value", F.when(source == "left", F.col("value_l")).otherwise(F.col("value_r")))
