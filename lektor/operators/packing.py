"""Ordered folds with a budget: packing lines into chunks, sharing a budget over texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunks(rows: DataFrame, key: str, order: str, text: str, budget: int, overlap: int = 2) -> DataFrame:
    """(key, chunk, order, text, repeated): lines packed in order up to a budget of characters; each chunk begins with the last lines of the one before.

    The fold depends on every line before it, so it runs per document, streaming over sorted rows; an over-long line has a chunk of its own.
    """
    kind = rows.schema[key].dataType.simpleString()

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, number, used, tail = None, 0, 0, []
        for batch in batches:
            out = []
            for k, i, line in zip(batch[key], batch[order], batch[text]):
                if now != k:
                    now, number, used, tail = k, 0, 0, []
                if used and used + len(line) + 1 > budget:
                    number, used = number + 1, 0
                    out += [(k, number, j, t, True) for j, t in tail]
                out.append((k, number, i, line, False))
                used += len(line) + 1
                tail = (tail + [(i, line)])[-overlap:] if overlap else []
            yield pd.DataFrame(out, columns=[key, "chunk", order, text, "repeated"])

    ordered = rows.select(key, F.col(order).cast("int").alias(order), text).repartition(key).sortWithinPartitions(key, order)
    return ordered.mapInPandas(apply, f"{key} {kind}, chunk int, {order} int, {text} string, repeated boolean")


def fitted(texts: DataFrame, key: str, item: str, size: str, budget: int) -> DataFrame:
    """Shares of a budget: everyone gets what they ask up to one common level (water-filling), as sums over sizes in ascending order."""
    w = Window.partitionBy(key).orderBy(size, item)
    every = Window.partitionBy(key)
    rows = texts.withColumn("_before", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_rest", F.count(F.lit(1)).over(every) - F.row_number().over(w) + 1)
    level = F.floor((F.lit(budget) - F.col("_before")) / F.col("_rest"))
    rows = rows.withColumn("_level", F.when(F.col(size) > level, level))
    first = F.max("_level").over(every)  # that of the first text above it; those behind are lower
    return rows.withColumn("share", F.least(F.col(size), F.coalesce(first, F.col(size)))).drop("_before", "_rest", "_level")
