"""Connected components by star contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark.llm.common import keep


def _lowest(edges: DataFrame) -> DataFrame:
    """For each u its smallest neighbour or itself; sums up before the shuffle, so hubs cost one row a task."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(keep(_lowest(both), "lowest"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = keep(_lowest(down), "lowest")
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, most: int = 200) -> DataFrame:
    """(node, root) for every node of the edges (a, b), the root being the smallest node it reaches.

    Alternates both contractions until no edge changes; each round is written to the shared folder, and so are the
    smallest neighbours, so that a hub's edges meet them in a plain join, which adaptive execution splits. Edges of a node to itself, null ends and
    repeated edges are passed over; without edges the result is empty.
    """
    now = keep(edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(most):
        now = keep(small_star(large_star(now)).where("u <> v").distinct(), "stars")
        new = tuple(now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        state = new
    raise RuntimeError("components did not settle")
