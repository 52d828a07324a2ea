"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the smallest id that links reach) of every id in an edge.

    Each step links neighbours to the smallest id around them; steps go on until none changes an edge,
    after a logarithmic number of them. Edges stay in the cluster, in a reliable checkpoint by step;
    joins on a much-linked id are ordinary ones, whose large partitions Spark divides.
    """
    links = saved(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), small=True)
    state = _signature(links)
    while state[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        links = saved(small, small=True)
        before, state = state, _signature(links)
        if state == before:
            break
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For numbers below n, the smallest number that the links (left, right) reach."""
    label = np.arange(n)
    while len(left):
        a, b = label[left], label[right]
        open_ = a != b
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))  # roots alone are hooked
        while (label[label] != label).any():
            label = label[label]
    return label
