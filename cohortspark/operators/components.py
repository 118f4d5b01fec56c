"""Connected components by alternating star contractions (two joins a round, O(log n) rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.lineage import cut


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Point the neighbours of every node at the least node around it.

    ``edges`` has ``hi > lo``. Both ways: larger neighbours are re-pointed (large star); one way:
    smaller neighbours and the node itself are (small star). Groups are only aggregated, never
    gathered into a list, so one node may hold any share of the edges.
    """
    sided = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
    if both_ways:
        sided = sided.unionByName(edges.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
    least = sided.groupBy("node").agg(F.min("other").alias("m"))
    least = least.select("node", F.least("node", "m").alias("m"))
    moved = sided.join(least, "node")
    if both_ways:
        moved = moved.where(F.col("other") > F.col("node")).select(F.col("other").alias("hi"), F.col("m").alias("lo"))
    else:
        moved = moved.select(F.col("other").alias("hi"), F.col("m").alias("lo"))
        moved = moved.unionByName(least.select(F.col("node").alias("hi"), F.col("m").alias("lo")))
    return moved.where("hi > lo").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node that has an edge; the component is its least node.

    Nodes without edges are their own component and are left to the caller. Null ends and loops
    are ignored; repeated edges count once. Raises if ``max_rounds`` do not suffice.
    """
    pairs = edges.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo"))
    pairs = cut(pairs.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).where("hi > lo").distinct())
    signature = None
    for _ in range(max_rounds):
        pairs = cut(_star(_star(pairs, True), False))
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == signature:
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        signature = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
