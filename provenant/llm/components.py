"""Connected components of an edge table by contraction: distributed, logarithmic rounds, nothing on the driver.

In each round every node takes the least of itself and its neighbours as parent, parents are followed to their
roots by pointer jumping, and edges are contracted to roots; nodes that aren't a local minimum vanish, so edges
shrink fast. Grouping is a minimum with partial sums, so a node with very many edges isn't gathered anywhere.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, stage


def local_components(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least member of the component of each of n nodes, by edges (x, y); in memory, for a block."""
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (jumped := new[new]).tobytes() != new.tobytes():
            new = jumped
        if (new == label).all():
            break
        label = new
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (u, v longs): root is the least node reachable. Self-loops and repeats don't matter."""
    cut = lambda e: e.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    left = stage(cut(edges), "edges")
    labels = None
    while left.limit(1).count():
        both = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = stage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), "parents")
        while True:
            up = broadcast_if_small(parents.select(F.col("u").alias("p"), F.col("p").alias("g")))
            jumped = stage(parents.join(up, "p").select("u", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved")), "parents")
            parents = jumped.select("u", "p")
            if not jumped.where("moved").limit(1).count():
                break
        up = broadcast_if_small(parents)
        if labels is None:
            labels = parents.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            labels = stage(labels.join(up.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
        over = up.select(F.col("u").alias("v"), F.col("p").alias("q"))
        left = stage(cut(left.join(up, "u").join(over, "v").select(F.col("p").alias("u"), F.col("q").alias("v"))), "edges")
    return left.select(F.col("u").alias("node"), F.col("v").alias("root")) if labels is None else labels
