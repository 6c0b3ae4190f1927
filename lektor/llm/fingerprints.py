"""Document fingerprints from closed syncmers, with DataFrame operations only.

A text is read as units: words between white space; in scripts that put no space between words, characters; words of more than 24 characters
are cut behind the next vowel, digit or mark of their own, so that an edit moves no unit but those around it. A k-mer is K consecutive
units, its inner substrings are the S-mers in it. A k-mer is selected when the least hash among its S-mers is that of the first or of the last
one, which depends on the k-mer alone: an edit changes no selection beyond the k-mers that it touches. The fingerprint is the sequence of
the selected k-mers' hashes, 32 bits each in hexadecimal, in text order; where no k-mer of a text is selected, as can happen to short ones, it is
the one of the least hash.

Fingerprints are compared by position: an anchor of one matches in the other where the anchor behind it (or the end) matches too. The likeness is
twice the number of distinct such links in both over the sum of their numbers: 1 for equal fingerprints (two empty ones too), 0 for none in
common. It is computed from the fingerprints that are returned.

Sliding minima come from pairwise ``zip_with`` of arrays, so the work is linear in the text and stays in the JVM.

Defined results: a null or empty text, or one of white space, has the empty fingerprint; a text of fewer than K units has each of
its units as an anchor; null doc_ids come last in the order of documents and equal doc_ids are ordered by a hash of their text; with a single
document the next document is itself; ids that many rows share, and null ones, are spread by that hash; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lektor.llm import tables

K, S = 5, 2
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"  # Thai, Lao, Burmese, Khmer, kana, Han
LETTER = rf"[^\x20\x09-\x0D{UNSPACED}]"
UNIT = rf"{LETTER}{{1,24}}(?!{LETTER})|[{UNSPACED}]|{LETTER}{{0,63}}?[AEIOUaeiou0-9+/=.,;:_-]|{LETTER}{{1,24}}"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shifted(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def _least(a: Column, by: int) -> Column:
    """Minima of each element and the one ``by`` behind it, while both exist."""
    return F.slice(F.zip_with(a, _shifted(a, by), lambda x, y: F.least(x, y)), F.lit(1), F.greatest(F.size(a) - by, F.lit(0)))


def anchors(text: Column) -> Column:
    """Hashes of the closed syncmers of a text, in order (array of 32-bit numbers)."""
    hashed = F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u))

    def selected(h: Column) -> Column:
        smers = F.slice(F.zip_with(h, _shifted(h, S - 1), lambda a, b: F.xxhash64(a, b)), F.lit(1), F.greatest(F.size(h) - (S - 1), F.lit(0)))
        width = K - S + 1  # four S-mers in a k-mer

        def pick(m: Column) -> Column:
            def with_least(w: Column) -> Column:
                kmer = lambda i: F.xxhash64(m[i], m[i + 1], m[i + 3]).bitwiseAND(0xFFFFFFFF)
                every = F.sequence(F.lit(0), F.size(m) - width)
                hit = F.filter(every, lambda i: (w[i] == m[i]) | (w[i] == m[i + (width - 1)]))
                return let(hit, lambda at: F.when(F.size(at) > 0, F.transform(at, kmer)).otherwise(F.array(F.array_min(F.transform(every, kmer)))))

            return let(_least(_least(m, 1), 2), with_least)

        long_enough = F.size(h) >= K
        return F.when(long_enough, let(smers, pick)).when(F.size(h) > 0, F.array(F.xxhash64(F.concat_ws(" ", F.transform(h, lambda x: F.hex(x)))).bitwiseAND(0xFFFFFFFF))).otherwise(F.array().cast("array<bigint>"))

    return let(hashed, selected)


def fingerprint(anchor: Column) -> Column:
    """As a string: each anchor in hexadecimal."""
    return F.concat_ws("", F.transform(anchor, lambda x: F.lpad(F.hex(x), 8, "0")))


def links(anchor: Column) -> Column:
    """Each anchor with the one behind it, 0 behind the last."""
    behind = F.concat(F.slice(anchor, F.lit(2), F.greatest(F.size(anchor) - 1, F.lit(0))), F.when(F.size(anchor) > 0, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>")))
    return F.zip_with(anchor, behind, lambda x, y: F.shiftleft(x, 32).bitwiseOR(y))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, from their links."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * both / total)


def in_order(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Rows (doc_id, text, bucket, tail, tie) and a window in which each row's next one is the next document of descending doc_id.

    Documents are cut into ranges of doc_id, those of an id that fills a range by itself (and those without one) into ranges of a hash
    of their text. The first row of each range is copied behind the last row of the range before it (tail = 1), so no window spans more than
    one range; which range comes before is worked out on ids alone.
    """
    parts = 4 * tables.width(docs.sparkSession)
    got = docs.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 20 * parts).alias("b")).first().b or []
    bounds = sorted(set(got))
    frequent = [b for b in bounds if got.count(b) > 1]
    below = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    rank = 1 + F.floor((F.shiftright("tie", 48) + 32768) * parts / 65536)  # 1 to parts, ascending
    spread = F.col("doc_id").isNull() | F.col("doc_id").isin(frequent)
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(below) * (parts + 1) + F.when(spread, rank).otherwise(0)
    rows = docs.withColumn("tie", F.xxhash64("text")).withColumn("bucket", bucket.cast("long"))
    heads = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("r"))
    to = Window.orderBy(F.col("bucket").asc())  # one row a range, of numbers; the range before is the one of larger ids
    everything = to.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("r.doc_id", "r.tie", F.coalesce(F.lead("bucket").over(to), F.first("bucket").over(everything)).alias("to"), F.col("bucket").alias("of"))
    same = (F.col("bucket") == F.col("of")) & rows.doc_id.eqNullSafe(heads.doc_id) & (rows.tie == heads.tie)
    moved = rows.join(F.broadcast(heads), same).groupBy("to").agg(F.first(F.struct(rows.doc_id, rows.text, rows.tie)).alias("r"))  # at most (parts + 1) ** 2 heads, a few numbers each
    rows = rows.withColumn("tail", F.lit(0)).unionByName(moved.select("r.doc_id", "r.text", "r.tie", F.col("to").alias("bucket"), F.lit(1).alias("tail")))
    return rows, Window.partitionBy("bucket").orderBy("tail", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, order = in_order(docs)
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 3) as int))"))
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("edited", F.when(F.col("tail") == 0, edited))
    rows = rows.select("doc_id", "bucket", "tail", "tie", n.alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), anchors(F.col("text")).alias("a"), anchors(F.coalesce("edited", F.lit(""))).alias("e"))
    rows = rows.withColumn("next_a", F.lead("a").over(order)).where("tail = 0")
    rows = rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"), links(F.col("a")).alias("la"), links(F.col("e")).alias("le"), links(F.col("next_a")).alias("ln"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("la"), F.col("le")).alias("near_edited"), likeness(F.col("la"), F.col("ln")).alias("near_next"))
