"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidspark.llm.common import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_000_007).cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (u, v): the label is the smallest node that can be reached.

    Each round attaches every larger neighbour of a node to its smallest neighbour, then every smaller one. Minima are
    combined before they are shuffled, and a round is written to the shared folder, so lineage stays short. Loops and
    repeated edges do no harm; an empty table gives no row.
    """
    u, v = F.greatest("u", "v"), F.least("u", "v")
    edges = materialize(edges.where("u <> v").select(u.alias("u"), v.alias("v")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = materialize(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges = materialize(small, "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return leaves.unionByName(roots)
