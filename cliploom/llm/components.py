"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations and joins on node ids; nothing is collected, and
each round's edges are written to the shared folder, so a lost executor costs at
most one round. The number of rounds grows with the logarithm of the number of edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, meet


#: A node of more than this share of the edges (and more than HUB edges) is a hub; so there are at most 2 * SHARE of them.
HUB, SHARE = 400, 4096


def _hubs(both: DataFrame, n_edges: int) -> tuple[set[int], set[int]]:
    """The hubs, and the nodes that their neighbours will be linked to, which may be hubs next."""
    limit = max(HUB, n_edges // SHARE)
    found = both.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("m")).where(F.col("n") > limit).select("a", "m").collect()
    return {r.a for r in found}, {r.a for r in found} | {min(r.a, r.m) for r in found}


def _hook(both: DataFrame, keep_larger: bool, hubs: set[int]) -> DataFrame:
    """Link the neighbours of each node to the least of them (or to the node, if it is less).

    The edges of a hub stay where they are: the hubs' few rows go to them. All others meet by node.
    """
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = meet(both, least, sorted(hubs), "a")  # 4 * SHARE hubs at most
    if keep_larger:
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    near = linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """From rows (a, b) of a graph, rows (id, component): the least id each node is linked to.

    Nodes without an edge don't occur. Loops and repeated edges don't matter; an
    empty table gives an empty table.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        now_hubs, next_hubs = _hubs(both, state[0])
        large = _hook(both, True, now_hubs).distinct()
        small = _hook(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), False, next_hubs).distinct()
        now = materialize(small, "edges")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
