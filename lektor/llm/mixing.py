"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

Every document of a source is expected ``target / source_size`` times. Within the source the expected copies are prefix-summed in a
fixed order, one random offset is added, and the document is emitted once for each integer boundary that its interval crosses. The
order puts documents of like size side by side, so the words taken differ from the target by about one document.

The prefix sum is hierarchical: documents fall into (source, size class, lane) cells, of which a source has at most a fixed number;
ranks are counted within cells and cell counts are summed per source. Thus a source holding a third of all rows is spread over its
cells and no task sees a whole source.

Targets: sources by code point, null last, weigh 3, 1, 2, repeating, and share ``factor`` times all words; a target stops at ``most`` times
the words of its source and the excess goes to the others by weight. As the sources are filled in the order of cap / weight, one pass of
prefix sums over them gives the fixed point.

Defined results: a null text is empty, of size 0, and takes nothing; null sources are one source of their own, last; repeated rows are
separate documents (equal ids are ordered among themselves arbitrarily, which moves no total); an empty table gives an empty result;
other columns are carried along by ``mix`` and ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lektor.llm import tables

WEIGHTS, FACTOR, MOST, LANES, SEED = (3, 1, 2), (3, 2), 2, 64, 20240607
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, factor: tuple = FACTOR, most: int = MOST) -> DataFrame:
    """(key, source_size, source_docs, target) of each source, from rows (key, size). Exact integers up to one last division."""
    up, down = factor
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    by_name = Window.orderBy("key")  # one row a source
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("w", w).withColumn("cap", F.lit(most * down) * F.col("source_size"))
    fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), "key")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    per = per.withColumn("left", F.lit(up) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("rest", F.sum("w").over(after))
    per = per.withColumn("full", F.col("cap") * F.col("rest") <= F.col("left") * F.col("w"))
    # the first source that isn't full fixes the level for all behind it
    level = Window.orderBy((F.col("cap") / F.col("w")).asc(), "key")
    per = per.withColumn("open", F.max((~F.col("full")).cast("int")).over(level.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    first = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pick = lambda c: F.first(F.when(F.col("open"), F.col(c)), ignorenulls=True).over(first)
    per = per.withColumn("l", pick("left")).withColumn("r", pick("rest"))
    target = F.when(F.col("open"), F.col("l").cast("double") * F.col("w").cast("double") / (F.col("r").cast("double") * down)).otherwise(F.col("cap").cast("double") / down)
    return per.select("key", "source_size", "source_docs", target.alias("target"))


def size_class(size) -> F.Column:
    """Bit length and the next three bits: classes about an eighth wide."""
    bits = F.length(F.bin(size))
    return (bits * 8 + F.when(bits >= 4, F.expr("shiftright(size, length(bin(size)) - 4) & 7")).otherwise(0)).cast("int")


def offset(key, seed: int = SEED) -> F.Column:
    """The source's random offset in [0, 1), the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def allot(rows: DataFrame, per: DataFrame, lanes: int = LANES, seed: int = SEED) -> DataFrame:
    """``rows`` (doc_id, key, size) with source_size, target, copies and taken."""
    rows = rows.withColumn("band", size_class(F.col("size"))).withColumn("lane", F.coalesce(F.pmod(F.col("doc_id"), F.lit(lanes)), F.lit(0)).cast("int"))
    cell = ["key", "band", "lane"]
    counts = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("key").orderBy("band", "lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))).join(per, "key").select(*cell, "before", "source_size", "source_docs", "target")
    within = Window.partitionBy(*cell).orderBy("size", "doc_id", "h")
    ranked = rows.withColumn("rank", F.row_number().over(within)).join(starts, cell)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    upto = lambda k: F.floor(k.cast("double") * F.col("rate") + F.col("u"))
    ranked = ranked.withColumn("rate", rate).withColumn("u", offset(F.col("key"), seed)).withColumn("at", F.col("before") + F.col("rank"))
    return ranked.withColumn("copies", (upto(F.col("at")) - upto(F.col("at") - 1)).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))


def source_key() -> F.Column:
    """A key that orders as the sources do, null last."""
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col("source").cast("string")))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, key, size, h), written once: one pass over the texts. h is a hash of the text."""
    text = F.col("text").cast("string")
    return tables.materialize(docs.select("doc_id", source_key().alias("key"), word_count(text).alias("size"), F.xxhash64(text).alias("h")), "mix-sizes")


def mix_counts(docs: DataFrame, weights: tuple = WEIGHTS, factor: tuple = FACTOR, most: int = MOST) -> DataFrame:
    rows = sized(docs)
    return allot(rows, targets(rows, weights, factor, most))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, factor: tuple = FACTOR, most: int = MOST) -> DataFrame:
    """The mixture itself: every document as often as the sampling takes it. Of rows that repeat id, source and text the one of least JSON stands
    for all, as often as all are taken. Columns of any name are kept as they are."""
    got = mix_counts(docs, weights, factor, most).groupBy("doc_id", "key", "h").agg(F.sum("copies").cast("int").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), source_key().alias("k"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    joined = rows.join(got, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key")) & (F.col("hash") == F.col("h")))
    alone = joined.where("rows = 1").select("row", "copies")
    many = joined.where("rows > 1").groupBy("doc_id", "key", "h").agg(F.min_by("row", F.to_json("row")).alias("row"), F.first("copies").alias("copies")).select("row", "copies")
    return alone.unionAll(many).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_counts(docs).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS key,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
p AS (SELECT key, sum(size)::BIGINT AS source_size, count(*) AS source_docs FROM d GROUP BY key),
q AS (SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT]::BIGINT AS w, (4 * source_size)::BIGINT AS cap FROM p),
r AS (SELECT *, 3 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l0,
             sum(w) OVER (ORDER BY cap / w, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r0 FROM q),
s AS (SELECT *, max(CASE WHEN cap * r0 <= l0 * w THEN 0 ELSE 1 END) OVER (ORDER BY cap / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS open FROM r),
t AS (SELECT *, first_value(CASE WHEN open THEN l0 END IGNORE NULLS) OVER (ORDER BY cap / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, first_value(CASE WHEN open THEN r0 END IGNORE NULLS) OVER (ORDER BY cap / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS r FROM s),
g AS (SELECT key, source_size, CASE WHEN open THEN l::DOUBLE * w::DOUBLE / (r::DOUBLE * 2) ELSE cap::DOUBLE / 2 END AS target,
             CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS rate,
             ('0x' || substr(md5(key || '|{SEED}'), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u FROM t),
e AS (SELECT doc_id, key, size, length(bin(size)) * 8 + CASE WHEN length(bin(size)) >= 4 THEN (size >> (length(bin(size)) - 4)) & 7 ELSE 0 END AS band,
             coalesce(doc_id % {LANES}, 0) AS lane FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY band, lane, size, doc_id) AS pos FROM e)
SELECT doc_id, size, source_size, target,
       ((floor(pos::DOUBLE * rate + u) - floor((pos - 1)::DOUBLE * rate + u)) * size)::BIGINT AS taken
FROM f JOIN g USING (key)
"""
