"""Connected components of links between documents, in rounds of joins; nothing but row counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm import shared

#: Steps between two writes: so many plans stay short, and few tables are written.
STEPS = 2


def _starred(pairs: DataFrame) -> DataFrame:
    """pairs (node, smaller root), each once, with each node's roots linked to the smallest of them.

    A pair makes one pair: that of the smallest root stays, another root is linked in its node's place, so no step has more
    links than the one before.
    """
    rows = pairs.withColumn("least", F.min("root").over(Window.partitionBy("node")))
    return rows.select(F.when(F.col("root") == F.col("least"), F.col("node")).otherwise(F.col("root")).alias("node"), F.col("least").alias("root")).distinct()


def _jumped(forest: DataFrame) -> DataFrame:
    """forest (node, root, moved) with each root replaced by its own root, where it has one."""
    above = forest.select(F.col("node").alias("root"), F.col("root").alias("above"))
    return forest.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.col("moved") | F.col("above").isNotNull()).alias("moved"))


def components(edges: DataFrame) -> DataFrame:
    """node, root for the nodes of edges (a, b) that aren't their component's smallest; root is the smallest.

    First each node's smaller neighbours are linked to the smallest of them, until every node has one smaller neighbour
    at most: a forest. Then each node's parent is replaced with its parent's parent until nothing changes.
    """
    pairs = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node <> root").distinct()
    while True:
        for _ in range(STEPS):
            pairs = _starred(pairs)
        pairs = shared.scratch(pairs, "links")
        rows, nodes = pairs.agg(F.count("*"), F.count_distinct("node")).first()
        if rows == nodes:
            break
    while True:
        forest = pairs.select("node", "root", F.lit(False).alias("moved"))
        for _ in range(STEPS):
            forest = _jumped(forest)
        forest = shared.scratch(forest, "forest")
        pairs = forest.select("node", "root")
        if forest.where("moved").isEmpty():
            return pairs
