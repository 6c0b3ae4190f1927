"""Ordered segmentation: islands, ranges, groups and neighbours over an order column, as window functions partitioned by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _upto(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def islands(rows: DataFrame, keys: list[str], order: list, start: Column, name: str = "island") -> DataFrame:
    """Number of starts up to each row: rows before the first start are island 0."""
    return rows.withColumn(name, F.sum(start.cast("int")).over(_upto(keys, order)).cast("long"))


def blocks(rows: DataFrame, keys: list[str], order: str, text: str, island: str = "island") -> DataFrame:
    """One row an island: first and last place, number of rows, texts joined in order by a space."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text))))
    return rows.groupBy(*keys, island).agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(ordered, lambda r: r[text]), " ").alias("block"))


def ranges(starts: DataFrame, keys: list[str], order: str, end: Column) -> DataFrame:
    """Half-open ranges from each start to the next one, the last to ``end``."""
    w = Window.partitionBy(*keys).orderBy(order)
    return starts.withColumn("stop", F.coalesce(F.lead(order).over(w), end))


def drop_groups(rows: DataFrame, keys: list[str], order: list, value: str, name: str = "grp") -> DataFrame:
    """A new group begins where the value falls."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return islands(rows.withColumn("_fell", F.coalesce(F.col(value) < F.lag(value).over(w), F.lit(False))), keys, order, F.col("_fell"), name).drop("_fell")


def runs(rows: DataFrame, keys: list[str], order: list, value: str, name: str = "run") -> DataFrame:
    """A new run begins where the value differs from the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(w)), F.lit(True)) & (F.row_number().over(w) > 1)
    return islands(rows.withColumn("_new", changed), keys, order, F.col("_new"), name).drop("_new")


def carried(rows: DataFrame, keys: list[str], order: list, value: Column, name: str) -> DataFrame:
    """The last value that isn't null so far."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(_upto(keys, order)))


def neighbours(rows: DataFrame, keys: list[str], order: list, text: Column) -> DataFrame:
    """The nearest values before and behind each row that aren't null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.last(text, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.first(text, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("before", before).withColumn("behind", behind)


def numbered(rows: DataFrame, keys: list[str], order: list, value: str, first: int = 1) -> DataFrame:
    """Whether a group's values are first, first + 1, ... in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("_want", F.row_number().over(w) - 1 + first)
    return rows.groupBy(*keys).agg(F.bool_and(F.col(value).eqNullSafe(F.col("_want"))).alias("regular"))


def ascending(rows: DataFrame, keys: list[str], order: list, value: Column) -> DataFrame:
    """Whether a group's values never fall."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("_v", value).withColumn("_ok", F.coalesce(F.col("_v") >= F.lag("_v").over(w), F.lit(True)))
    return rows.groupBy(*keys).agg(F.bool_and("_ok").alias("in_order"))


def zipped(left: DataFrame, right: DataFrame, keys: list[str], left_order: list, right_order: list) -> DataFrame:
    """The k-th row of one side beside the k-th of the other."""
    a = left.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*left_order)))
    b = right.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*right_order)))
    return a.join(b, [*keys, "place"])


def spread(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """n rows a group, evenly spaced; all where there are no more."""
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("_k", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    slot = F.floor(F.col("_k") * n / F.col("_n"))
    before = F.floor((F.col("_k") - 1) * n / F.col("_n"))
    return rows.where((F.col("_n") <= n) | (F.col("_k") == 0) | (slot > before)).drop("_k", "_n")
