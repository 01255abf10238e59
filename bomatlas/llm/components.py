"""Connected components of a graph too large for one task.

Each task first shrinks its own edges to a spanning forest of stars (smallest node in the
middle), then alternating large-star and small-star steps join the stars across tasks. Rows
never exceed the edges given, and the number of rounds grows with the logarithm of the nodes.
As soon as the edges left are few enough for a task of bounded size, one task joins them: a
round is six shuffles, whose tasks cost the driver more than such a remainder is worth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomatlas.llm.common import stored
from bomatlas.llm.tokens import gathered

#: Edges that one task joins (16 MB of numbers); more are joined in rounds across tasks.
EDGES_AT_ONCE = 1 << 20


def roots(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of the nodes 0 to n - 1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
        if (label == before).all():
            return label


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = gathered(batches)
    if table is None:
        return
    left, right = table.column("u").to_numpy(), table.column("v").to_numpy()
    nodes, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    label = roots(where[: len(left)], where[len(left) :], len(nodes))
    leaf = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.record_batch([pa.array(nodes[leaf]), pa.array(nodes[label[leaf]])], names=["u", "v"])


def _settled(stars: DataFrame) -> bool:
    """Whether every node points to one other at most, and to none if another points to it."""
    out = stars.select(F.col("u").alias("node"), F.lit(1).alias("to"), F.lit(0).alias("by"))
    back = stars.select(F.col("v").alias("node"), F.lit(0).alias("to"), F.lit(1).alias("by"))
    nodes = out.unionByName(back).groupBy("node").agg(F.sum("to").alias("to"), F.max("by").alias("by"))
    return nodes.where((F.col("to") > 1) | ((F.col("to") > 0) & (F.col("by") > 0))).limit(1).count() == 0


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` (its smallest node) for every node on an edge; ``edges``: longs ``u, v``."""
    edges = edges.select("u", "v").where("u <> v")
    stars = stored(edges.mapInArrow(_stars, "u long, v long").distinct(), name)
    while (few := stars.count() <= EDGES_AT_ONCE) or not _settled(stars):
        if few:
            stars = stored(stars.coalesce(1).mapInArrow(_stars, "u long, v long"), name)
            break
        # Large star: larger neighbours move to the smallest of a node's neighbourhood.
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(low, "u").select("v", "u", "least")
        moved = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        stars = stored(moved, name)
    leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
