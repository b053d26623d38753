"""Connected components by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014).
Each round is two group-by-minimum aggregations (map-side combined, so a hub
with a third of all edges sends one row per task) and equi-joins that adaptive
execution can split. Long chains take O(log^2 n) rounds, not their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.plans.lineage import cut, drop_table

#: Rounds after which a run stops with an error instead of looping for ever.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """For each node, link its larger neighbours to its smallest one."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """For each node, link its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(low.select("u", F.col("m").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Whether each node links to one root, and no root links on; such stars no round would change."""
    ends = edges.select("u", F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or (below = 1 and above = 1)").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of ``edges``, the component named by its smallest node.

    Null endpoints are dropped, self-loops give a component of one. Works for
    any orderable key type. Empty input gives an empty result.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = pairs.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    now, last = pairs.where("u <> v"), None
    for _ in range(MAX_ROUNDS):
        step = cut(_small_star(_large_star(now)).where("u <> v").distinct(), "edges")
        if last is not None:
            drop_table(last)
        now = last = step
        if _settled(now):
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(roots).union(loops).groupBy("node").agg(F.min("component").alias("component"))
