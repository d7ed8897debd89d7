"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import saved


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the least node reachable.

    Alternates large-star and small-star steps, which replace a node's links by
    links to its least neighbour, until nothing changes; about log(longest
    chain) rounds. Minima combine on the map side, so a node with many links
    gathers nowhere. Each round is written to the shared folder.
    """
    greatest, least = F.greatest("a", "b"), F.least("a", "b")
    now = saved(edges.filter("a <> b").select(greatest.alias("u"), least.alias("v")).distinct())
    mark = _digest(now)
    while mark[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least_of = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least_of, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least_of = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least_of, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = saved(moved.unionAll(least_of.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _digest(now)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(roots)
