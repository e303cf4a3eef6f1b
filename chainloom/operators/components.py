"""Connected components of a graph held in DataFrames.

Alternating large-star and small-star steps: every step replaces edges so that
each node points at smaller ones, until every node points at the least node of
its component.  Per step there is one aggregation (combined map-side) and one
join of the edges with one row per node, so a hub that holds a third of all
edges is split by the skew join and never gathered in a task.  Each step is
written to the shared folder, which cuts the lineage; the step before is removed.

Defined results: edges with a null end are ignored, self loops make a component
of one node, repeated edges count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.sources.checkpoints import Stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return near.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge points down (u > v) here
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node has one target and no target is itself a source: the
    state in which all edges point at the least node of their component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("inward"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("inward")))
    roles = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("inward").alias("inward"))
    return roles.where("out > 1 or (out = 1 and inward = 1)").isEmpty()


def connected_components(edges: DataFrame, source: str = "src", target: str = "dst", most_steps: int = 60) -> DataFrame:
    """Output (node, component): component is the least node reachable.  Nodes are
    compared as they are, so both ends must have one comparable type."""
    pairs = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a is not null and b is not null")
    loops = pairs.where("a = b").select(F.col("a").alias("node")).distinct()
    down = pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = Stored(down)
    for _ in range(most_steps):
        large = Stored(_large_star(now.df))
        after = Stored(_small_star(large.df))
        large.drop()
        now.drop()
        now = after
        if _is_star_forest(now.df):
            break
    else:
        raise RuntimeError(f"components did not settle in {most_steps} steps")
    stars = now.df
    members = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    leads = stars.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    tied = members.unionByName(leads)
    return tied.unionByName(loops.join(tied.select("node"), "node", "left_anti").withColumn("component", F.col("node")))
