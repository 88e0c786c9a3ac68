"""Connected components by alternating large and small stars, each a few joins and aggregates."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.session import cut_lineage


def least_reached(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of ``ids`` that each place reaches by links between the places ``a`` and ``b``, inside one task."""
    value = ids.copy()
    while True:
        least, last = np.minimum(value[a], value[b]), value.copy()
        np.minimum.at(value, a, least)
        np.minimum.at(value, b, least)
        if (value == last).all():
            return value


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("src").agg(F.min("dst").alias("least"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node it knows."""
    both = edges.union(edges.select("dst", "src"))
    least = _least(both).withColumn("least", F.least("src", "least"))
    return (
        both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).distinct()
    )


def small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    joined = edges.join(_least(edges), "src")
    moved = joined.filter("dst > least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return moved.union(joined.select("src", F.col("least").alias("dst"))).distinct()


def _state(edges: DataFrame):
    mark = F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))
    return edges.agg(F.count(F.lit(1)), mark).first()


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every node of ``edges`` (``src, dst``): the smallest node it can reach.

    Nulls and loops are ignored.  Each round ends in a checkpoint in the shared folder; the rounds end when the
    links stay the same, after a number of rounds that grows with the logarithm of the largest component.
    Only two numbers a round reach the driver.  A node with very many links needs no task of its own: minima
    are combined before they are shuffled, and joins on it can be split.
    """
    edges = cut_lineage(
        edges.filter("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    )
    state = _state(edges)
    while True:
        edges = cut_lineage(small_star(large_star(edges)))
        state, last = _state(edges), state
        if state == last:
            break
    stars = edges.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())
