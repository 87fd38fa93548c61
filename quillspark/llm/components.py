"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    """Written, so that the join with it has a plain shuffle on both sides, which is what skewed joins are split by."""
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    out = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large-star")
    discard(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = materialize(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    discard(least), discard(edges)
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour, which has none itself."""
    if edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").take(1):
        return False
    return not edges.groupBy("u").count().where("count > 1").take(1)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node that has an edge with the smallest node it reaches.

    `edges` has two long columns `u` and `v`, in any direction, repeats allowed; rows with a null or
    with u = v are ignored. Returns (node long, component long) for each node that is not itself the
    smallest of its component; an empty input gives an empty table. Minima are taken by a partial
    aggregate, so a hub with a third of all edges is summed before the shuffle, and joined back, where
    adaptive execution splits its rows. Each star is written to the shared folder.
    """
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        after = _small_star(_large_star(e))
        discard(e)
        e = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
