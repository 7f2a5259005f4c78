"""Connected components of an edge table by alternating star contractions.

Each round rewrites edges towards the smallest neighbour and halves the depth of
what is left, so chains take a logarithmic number of rounds.  Neighbours are never
gathered: a node's smallest neighbour is an aggregate, and the join that hands it
out is one that Spark can split at hot nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of those."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").where("v <> m").select("v", "m").toDF("u", "v").union(least.toDF("u", "v"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of each node that has an edge, from columns u and v of ``edges``.

    ``component`` is the smallest node reachable.  Loops and edges with a null end are
    ignored; an empty table gives an empty result.
    """
    now = staged(edges.select("u", "v").where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        step = _small_star(_large_star(now).where("u <> v").distinct()).where("u <> v").distinct()
        now = staged(step, "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
