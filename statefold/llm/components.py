"""Connected components of undirected links between hashed nodes, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statefold.llm.common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp for every node with a link; comp is one node of the component.

    Each round sends a node to the least of itself and its neighbours and renames the links' ends; as nodes are hashes,
    their order is random and the number of links falls by a constant factor a round. Least neighbours are combined before
    the shuffle, so a node with very many links is no hot key.
    """
    edges = materialize(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
        if labels is None:
            labels = least.select(F.col("u").alias("node"), F.col("m").alias("comp"))
        else:
            moved = labels.join(least, labels.comp == least.u, "left")
            labels = materialize(moved.select("node", F.coalesce("m", "comp").alias("comp")), "labels")
        left = edges.join(least, edges.a == least.u).select(F.col("m").alias("a"), "b")
        renamed = left.join(least, left.b == least.u).select("a", F.col("m").alias("b")).where("a <> b")
        edges = materialize(renamed.distinct(), "links")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
