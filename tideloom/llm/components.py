"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.llm.common import keep


def components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): ``root`` is the smallest node that can be reached.

    Large-star and small-star steps in turn: each node links its neighbours to the smallest node it knows. A step is an
    aggregate and a join on the node, so a node with very many links is combined before the shuffle and split by the
    skew join. Every step is a table in the shared folder.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = keep(edges, purpose)
    before = _state(edges)
    while True:
        edges = keep(_small_star(keep(_large_star(edges), purpose)), purpose)
        after = _state(edges)
        if after == before:
            break
        before = after
    # stable: every edge leads to the root of its component
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _state(edges: DataFrame):
    mark = F.pmod(F.xxhash64("u", "v"), F.lit(1 << 32))
    return tuple(edges.agg(F.count("*"), F.sum(mark), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 32)))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return out.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
