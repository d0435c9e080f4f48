"""Connected components of an edge table by alternating stars.

Each round is two joins with per-node minima.  The minima are aggregates with
map-side combining and neighbour lists are never gathered; the joins spread
the edges of hubs, so a hub that a third of the edges touch costs a task no
more than its share of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_join, written


def _minima(edges: DataFrame) -> DataFrame:
    """``u, m, degree``: each node's smallest neighbour and number of edges."""
    return written(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")), "minima")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``links(u, v)``; component: its smallest node.

    Direction and repeats of links do not matter; an empty table gives none.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _minima(both).withColumn("m", F.least("u", "m"))
        large = group_join(both.where("v > u"), low, "u", "degree", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-stars")
        down = _minima(large)
        small = group_join(large, down, "u", "degree", "v").where("v <> m").select("v", "m")
        small = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = written(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
