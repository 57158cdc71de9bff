"""Connected components by alternating large-star and small-star steps.

Each step replaces a node's edges by edges to its smallest neighbour. Minima are pre-aggregated,
then joined back with plain exchanges on either side, so a node with very many neighbours is split.
Steps are written to the shared folder, which cuts the lineage; about log of the longest path's
length of them are needed, and stars, which the callers mostly give, need one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import again_shuffled, materialize, release

MAX_STEPS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v), u != v. large: every neighbour v > u goes to min(u, neighbours of u); small: u and its neighbours v < u go to the least of them."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = again_shuffled(both.groupBy("u").agg(F.min("v").alias("m")))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """edges(u, v), any integers -> node, root: for every node with an edge to another one, the least node it is connected to. files: as materialize has it, for each step."""
    state_of = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 31)).alias("h")).first()
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), files)
    before = state_of(edges)
    for _ in range(MAX_STEPS):
        after = materialize(_star(_star(edges, True), False), files)
        state = state_of(after)
        release(edges)
        edges = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("connected components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
