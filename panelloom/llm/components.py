"""Connected components of an edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import cut_lineage


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Link the neighbours of every node to the smallest of them.

    The minimum is an aggregate joined back, so that a node with very many
    neighbours combines map-side and its join can be split.
    """
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(lowest, "a")
    if larger:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    own = lowest.select("a", F.col("m").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b), root the smallest node reachable.

    Every round is checkpointed. Rounds grow as the square of the logarithm of
    a component's size at most; what comes to the driver is a count and a sum.
    """
    current = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = tuple(state)
        current = cut_lineage(_stars(_stars(current, True), False))
