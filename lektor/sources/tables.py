"""Parquet tables of a folder, and the paragraphs of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def paragraphs(docs: DataFrame, *carry: str) -> DataFrame:
    """(doc_id, carry..., idx, line): the non-blank lines of each text with their place."""
    rows = docs.select("doc_id", *carry, F.posexplode(F.split("text", "\n")).alias("idx", "raw"))
    return rows.select("doc_id", *carry, "idx", F.trim("raw").alias("line")).where("line <> ''")


def spread(rows: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores, for work that outweighs a shuffle; a table that is read in more pieces stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
