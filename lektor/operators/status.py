"""The four-state status lattice, findings, and their roll-ups.

A finding has a code, a document, a status (pass, fail, na, needs_review) and a flag for partial passes. All folds are aggregates with
map-side partials; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK = {"fail": 3, "needs_review": 2, "changed": 1, "pass": 0}


def fold(status: Column, partial: Column) -> Column:
    """Any fail: fail; all na: na; all pass or na and none partial: pass; else null."""
    return (
        F.when(F.bool_or(status == "fail"), "fail")
        .when(F.bool_and(status == "na"), "na")
        .when(F.bool_and(status.isin("pass", "na") & ~F.coalesce(partial, F.lit(False))), "pass")
    )


def finding(code: str, doc: Column, status: Column, message: Column, partial: Column | bool = False) -> list[Column]:
    flag = partial if isinstance(partial, Column) else F.lit(partial)
    return [F.lit(code).alias("code"), doc.alias("doc"), status.alias("status"), message.alias("message"), flag.alias("partial")]


def cells(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy(*keys).agg(fold(F.col("status"), F.col("partial")).alias("status"), F.count(F.lit(1)).alias("n"))


def derived(findings: DataFrame, code: str, parts: list[str], key: str = "doc") -> DataFrame:
    """One finding a document from those of its component codes: fail if any fails, pass if all pass or na and none is partial, else review."""
    own = findings.where(F.col("code").isin(parts)).groupBy(key).agg(fold(F.col("status"), F.col("partial")).alias("s"))
    return own.select(F.lit(code).alias("code"), key, F.when(F.col("s") == "na", "pass").otherwise(F.coalesce("s", F.lit("needs_review"))).alias("status"))


def rollup(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts by status, the verdict, and a note."""
    out = findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pass", "fail", "na", "needs_review")],
        fold(F.col("status"), F.col("partial")).alias("verdict"),
    )
    return out.withColumn("note", F.when(F.col("n_fail") > 0, F.concat_ws(" ", F.col("n_fail").cast("string"), F.lit("of"), F.col("n").cast("string"), F.lit("documents fail"))).otherwise(""))


def grid(findings: DataFrame, row: str, codes: list[str]) -> DataFrame:
    """One row a key, one column a code, each cell folded."""
    return findings.groupBy(row).pivot("code", codes).agg(fold(F.col("status"), F.col("partial")))


def overview(findings: DataFrame, key: str) -> DataFrame:
    """Open items by key, worst first, with the example of the first failure, else of the first review."""
    open_ = findings.where(F.col("status").isin("fail", "needs_review"))
    first = lambda s: F.min(F.when(F.col("status") == s, F.struct("doc", "message")))
    got = open_.groupBy(key).agg(F.count_if(F.col("status") == "fail").alias("fails"), F.count_if(F.col("status") == "needs_review").alias("reviews"), F.coalesce(first("fail"), first("needs_review")).alias("e"))
    return got.select(key, "fails", "reviews", F.col("e.doc").alias("example_doc"), F.col("e.message").alias("example"))


def worst(status: Column) -> Column:
    rank = F.coalesce(*[F.when(status == s, r) for s, r in RANK.items()])
    return F.max_by(status, rank)


def after_repair(findings: DataFrame, again: DataFrame, handled: list[str]) -> DataFrame:
    """Open findings on handled codes give way to the second look, and vanish where it passes; the others stay."""
    mine = F.col("code").isin(handled) & F.col("status").isin("fail", "needs_review")
    redone = findings.where(mine).select("code", "doc").distinct().join(again, ["code", "doc"]).where("status <> 'pass'")
    return findings.where(~mine).unionByName(redone.select(*findings.columns))


def latest(rows: DataFrame, key: str, version: Column, path: str) -> DataFrame:
    """Rows with a flag for all but the newest version; ties keep the later path."""
    w = Window.partitionBy(key).orderBy(version.desc(), F.col(path).desc())
    return rows.withColumn("superseded", F.row_number().over(w) > 1)


def cell_notes(findings: DataFrame, *keys: str) -> DataFrame:
    """(keys, note): what isn't simply passed in a cell, code by code: fails, partial passes, and what a reviewer decides."""
    said = F.when(F.col("status") == "fail", F.concat("code", F.lit(": "), "message")).when((F.col("status") == "pass") & F.col("partial"), F.concat("code", F.lit(" (auto, partial): "), "message")).when(F.col("status") == "needs_review", F.concat("code", F.lit(" (reviewer): "), "message"))
    return findings.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(said)), " | ").alias("note"))


def inventory(docs: DataFrame) -> DataFrame:
    """(doc_type, n): documents by kind, null for what wasn't recognised."""
    return docs.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"))


def missing(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """(chapter, lesson, variant, doc_type): kinds of lesson documents that a lesson of the package lacks."""
    lessons = docs.where("scope = 'lesson' and chapter is not null").select("chapter", "lesson", "variant").distinct()
    every = lessons.withColumn("doc_type", F.explode(F.array(*map(F.lit, wanted))))
    have = docs.where("not superseded").select("chapter", "lesson", "variant", "doc_type").distinct()
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("chapter", "lesson", "variant", "doc_type")]
    return every.alias("w").join(have.alias("h"), same, "left_anti")


# Results about other documents of a package.
ABOUT_PACKAGE = ("PQ1", "PQ2", "PQ3", "PQ4", "PQ5", "DB1", "DB2", "DB3", "DB4", "DB5", "DBS1", "ST1", "ST2", "CE1", "CE4", "CE5", "WS1", "WS2", "WS3", "WS4", "WS5", "WS6", "LP3")


def uploaded(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Findings without those on what else a package lacks, where single files without folders were given."""
    single = docs.agg(F.bool_and(~F.col("rel").contains("/")).alias("_single"))  # one row
    absent = F.col("doc").isNull() & F.col("code").isin(*ABOUT_PACKAGE) & F.col("status").isin("fail", "needs_review")
    return findings.crossJoin(F.broadcast(single)).where(~(F.coalesce("_single", F.lit(False)) & absent)).drop("_single")


def checklist(findings: DataFrame, registry: DataFrame) -> DataFrame:
    """(code, text, automated, verdict, n): every rule of a registry (code, text, automated) with its findings' verdict; rules no finding answers keep their row."""
    own = findings.groupBy("code").agg(fold(F.col("status"), F.col("partial")).alias("verdict"), F.count(F.lit(1)).alias("n"))
    return registry.join(own, "code", "left").select("code", "text", F.coalesce("automated", F.lit("no")).alias("automated"), "verdict", F.coalesce("n", F.lit(0)).alias("n"))


def lesson_order() -> list[Column]:
    """The order of lessons: by chapter, whole chapters first, then lesson and part."""
    return [F.coalesce("chapter", F.lit(0)).asc(), F.coalesce("lesson", F.lit(-1)).asc(), F.coalesce("variant", F.lit("")).asc()]
