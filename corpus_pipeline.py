"""A corpus in five stages: quality, near copies, repeated passages, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All but the
last return the columns of ``documents``. What a stage keeps in the shared folder while it runs is removed when the next one starts on a
result that has been written; one that starts on the frame itself leaves the tables it reads from alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lektor.llm import mixing, near_copies, pieces, quality, repeats, tables

_leftover: list[str] = []


def _stage(body: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _leftover else []
        for path in [p for p in _leftover if not any(p in f for f in read)]:
            tables.drop_path(spark, path)
            _leftover.remove(path)
        since = tables.mark()
        out = body(spark, docs, sf_dir)
        _leftover.extend(tables.take(since))
        return out

    return run_stage


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, tables.read(spark, sf_dir, "labels")))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_copies.keep_one(docs).select(*docs.columns)


@_stage
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that stand elsewhere too are taken out of the texts; every document stays."""
    return repeats.remove(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix(docs)


@_stage
def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text's best segmentation, and how far the next ones fall behind."""
    return pieces.encode(docs, pieces.model_path())


STAGES = [("quality", keep_good), ("near_copies", drop_near_copies), ("repeats", drop_repeats), ("mixture", mix_sources), ("pieces", to_pieces)]

#: The quality scores, the classes of near copies and the lattice search can't be put in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = tables.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = tables.new_path(spark, f"stage-{k}-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
