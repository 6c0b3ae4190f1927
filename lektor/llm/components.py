"""Connected components of links between 64-bit nodes, by alternating large-star and small-star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektor.llm import tables


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour of a node to the least node around it: the larger neighbours (large) or the node and its smaller ones (small)."""
    if large:
        around = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = around.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _sum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(F.xxhash64("a", "b"), 20)).alias("s")).first()
    return r.n, r.s


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """(node, component): the least node of each component, for nodes that have a link. ``edges`` is a written table (a, b)."""
    now = tables.materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label)
    before = _sum(now)
    while before[0]:
        now = tables.materialize(_star(_star(now, True), False), label)
        after = _sum(now)
        if after == before:
            break
        before = after
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
