"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014) on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import staged


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v) with m, the least of u and its partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Edges point from the larger node to smaller ones."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = _with_least(down)
    links = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.union(joined.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root) for every node of an edge between different nodes; the root is the least node.

    Each round is written to the shared folder and ends when it changes nothing. Nulls are no nodes;
    repeated edges and loops count nothing; without edges the result is empty.
    """
    current = staged(edges.where("a is not null and b is not null and a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
    if current.isEmpty():
        return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = None
    while True:
        current = staged(_small(_large(current).distinct()).distinct(), "edges")
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
