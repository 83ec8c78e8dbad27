"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.llm.common import discard, store


def _distinct_edges(df: DataFrame) -> DataFrame:
    return df.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) of one comparable type -> (node, component): the least node that links reach; one row for each node of a pair of distinct nodes.

    Nulls are dropped. Every step is an aggregation with map-side combining and a join with its result, of which a hub's edges are the long side, so that Spark can
    deal them over tasks; each round is written to the shared folder, and the number of rounds grows with the logarithm of the number of nodes."""
    edges = store(_distinct_edges(pairs.select("u", "v").dropna()), "edges")
    mark = _mark(edges)
    while mark[0]:
        large = store(_distinct_edges(_large_star(edges)), "large")
        small = store(_distinct_edges(_small_star(large)), "small")
        discard(edges, large)
        edges, before, mark = small, mark, _mark(small)
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
