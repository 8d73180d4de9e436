"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def local_labels(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of ``n`` nodes over the given edges, within one task."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``u, v`` edges that has a neighbour; the component is its smallest node.

    Each round hangs neighbourhoods on their smallest node; a table in the shared folder ends it, so lineage stays short. The
    minimum of a hot node's neighbours is pre-aggregated, the join that follows can be split. Loops and double edges do no
    harm; an empty table gives an empty result.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    e = staged(e, "components")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    seen = e.select(mark).first()[0]
    while seen[0]:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("low")).select("x", F.least("x", "low").alias("low"))
        large = both.join(low, "x").filter("y > x").select(F.col("y").alias("u"), F.col("low").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").filter("v != low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("u", F.col("low").alias("v")))
        before, e = e, staged(small.distinct(), "components")
        discard(before)
        now = e.select(mark).first()[0]
        if now == seen:
            break
        seen = now
    both = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out = staged(both, "components")
    discard(e)
    return out
