"""Connected components of a graph by alternating large-star and small-star steps.

Each step is a minimum for each node and a join back, so no node's neighbours are ever gathered in one place; a hub's
rows are split by Spark's skew join. The steps end when they change nothing: then each node hangs on the least node of
its component.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Edges in a partition, about.
PART_EDGES = 250_000


def _linked(edges: DataFrame, both: bool) -> DataFrame:
    """(u, v, least): each edge with the least of u and its neighbours (both: all neighbours, else the smaller ones)."""
    ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = ways.groupBy("u").agg(F.min("v").alias("least"))
    return ways.join(least, "u").select("u", "v", F.least("u", "least").alias("least"))


def large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the least node around it."""
    return _linked(edges, both=True).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of these."""
    down = _linked(edges, both=False)
    return down.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(down.select("u", F.col("least").alias("v"))).filter("u > v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of each node of edges (u, v): component is the least node that it can reach."""
    edges = keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        state = _state(edges)
        if state == before or not state[0]:
            break
        before = state
        # no step makes more edges; so few of them as a rule that many small files would cost more than they hold
        parts = max(1, math.ceil(state[0] / PART_EDGES))
        edges = keep(small_star(large_star(edges.coalesce(parts))).coalesce(parts))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
