"""Movement: each operator adds ``target`` (null: stays) and, where borders absorb, ``is_dead``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.draws import pick, u
from cohortspark.operators.rates import DEAD


def _neighbours(edges: DataFrame) -> DataFrame:
    """One row per cell; the degree is at most six."""
    return edges.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "nbr"))), lambda e: e["nbr"]).alias("nbrs"))


def random_move(agents: DataFrame, edges: DataFrame, prob: float, seed: int, step: int, absorbing: bool = False) -> DataFrame:
    """With probability ``prob`` to a uniform neighbour. Reflecting: missing neighbours are no choice; absorbing: they kill."""
    joined = agents.join(_neighbours(edges), "cell")
    choices = F.col("nbrs") if absorbing else F.filter("nbrs", lambda n: n >= 0)
    goes = (u(seed, step, "move", F.col("id")) < prob) & (F.col("life_state") > DEAD) & (F.size(choices) > 0)
    to = F.when(goes, F.get(choices, pick(u(seed, step, "where", F.col("id")), F.size(choices))))
    out = joined.withColumn("target", to).drop("nbrs")
    if absorbing:
        out = out.withColumn("is_dead", F.coalesce(F.col("target") < 0, F.lit(False))).withColumn("target", F.when(F.col("target") >= 0, F.col("target")))
    return out


def random_move_1d(agents: DataFrame, edges: DataFrame, prob: float, seed: int, step: int) -> DataFrame:
    """Left or right only (neighbours 0 and 2)."""
    joined = agents.join(_neighbours(edges), "cell")
    goes = (u(seed, step, "move", F.col("id")) < prob) & (F.col("life_state") > DEAD)
    side = F.when(u(seed, step, "where", F.col("id")) < 0.5, F.get("nbrs", F.lit(0))).otherwise(F.get("nbrs", F.lit(2)))
    return joined.withColumn("target", F.when(goes & (side >= 0), side)).drop("nbrs")


def angular_error(wanted: Column, angle: Column) -> Column:
    """The difference of two directions, turned by a full circle when over a quarter."""
    d = wanted - angle
    return F.when(d > math.pi / 2, d - 2 * math.pi).when(d < -math.pi / 2, d + 2 * math.pi).otherwise(d)


def directed_move(agents: DataFrame, edges: DataFrame, min_age: float = 5.0) -> DataFrame:
    """The neighbour nearest to the direction corrected by the carried error (columns ``direction, error, age``); edges have ``angle``."""
    turns = edges.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("k", "nbr", "angle"))).alias("turns"))
    joined = agents.join(turns, "cell")
    wanted = F.col("direction") - F.col("error")
    scored = F.transform("turns", lambda e: F.struct(F.abs(angular_error(wanted, e["angle"])).alias("d"), e["k"].alias("k"), e["nbr"].alias("nbr"), e["angle"].alias("angle")))
    best = F.array_min(scored)
    moves = (F.col("life_state") > DEAD) & (F.col("age") > min_age)
    out = joined.withColumn("best", F.when(moves, best))
    return out.withColumns(
        {"target": F.col("best.nbr"), "new_error": F.when(moves, F.col("error") + F.col("best.angle") - F.col("direction")).otherwise(F.col("error"))}
    ).drop("turns", "best")


def weighted_move(agents: DataFrame, cum: DataFrame, env: DataFrame, prob: float, seed: int, step: int, uniform_if_zero: bool = False) -> DataFrame:
    """By cumulated weights over [self, neighbours]; from ice nobody moves.

    The plain form lets an agent go only if a second draw is over the share of neighbours without
    weight, and then draws between the own weight and the total (neighbours only; uniform over all
    places if those weights are nil). The other form draws over everything, uniformly if the total
    is 0. (The plain form tests "all weights equal" on the last place, where the reference stops
    one short.)
    """
    tables = cum.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("k", "nbr", "cum"))).alias("t"))
    joined = agents.join(tables, "cell").join(env.select("cell", "ice"), "cell")
    n = F.size("t") - 1
    own, total = F.get("t", F.lit(0))["cum"], F.element_at("t", -1)["cum"]
    r = u(seed, step, "where", F.col("id"))
    at_random = F.get("t", pick(r, n + 1))
    if uniform_if_zero:
        chosen = F.when(total > 0, F.get(F.filter("t", lambda e: r * total < e["cum"]), F.lit(0))).otherwise(at_random)
        goes = F.lit(True)
    else:
        steps = F.transform(F.sequence(F.lit(1), n), lambda i: (F.get("t", i)["cum"] == F.get("t", i - 1)["cum"]).cast("int"))
        shut = F.aggregate(steps, F.lit(0), lambda a, b: a + b)
        goes = u(seed, step, "shut", F.col("id")) > shut / n
        drawn = own + r * (total - own)
        chosen = F.when(total > own, F.get(F.filter("t", lambda e: drawn < e["cum"]), F.lit(0))).otherwise(at_random)
    goes = goes & (u(seed, step, "move", F.col("id")) < prob) & (F.col("life_state") > DEAD) & ~F.col("ice")
    out = joined.withColumn("chosen", F.when(goes, chosen))
    moved = (F.col("chosen.k") >= 0) & (F.col("chosen.nbr") >= 0)
    return out.withColumn("target", F.when(moved, F.col("chosen.nbr"))).drop("t", "ice", "chosen")


def allow_if(moves: DataFrame, values: DataFrame, column: str, factor: float = 0.2) -> DataFrame:
    """Keeps a target only if ``factor`` times its value is at least the current cell's."""
    here = values.select("cell", F.col(column).alias("__here"))
    there = values.select(F.col("cell").alias("target"), F.col(column).alias("__there"))
    joined = moves.join(here, "cell", "left").join(there, "target", "left")
    return joined.withColumn("target", F.when(F.col("__there") * factor >= F.col("__here"), F.col("target"))).drop("__here", "__there")


def confine(moves: DataFrame, allowed: DataFrame) -> DataFrame:
    """Targets outside the allowed cells are given up."""
    ok = allowed.select(F.col("cell").alias("target"), F.lit(True).alias("__ok"))
    joined = moves.join(ok, "target", "left")
    return joined.withColumn("target", F.when(F.col("__ok"), F.col("target"))).drop("__ok")


def navigation_table(nav_edges: DataFrame, p0: float, d0: float, decay: float) -> DataFrame:
    """``port, dest, p``: p = A exp(decay * dist) with A = p0 / exp(decay * d0). A port whose probabilities reach 1 is left out."""
    a = p0 / math.exp(decay * d0)
    probs = nav_edges.withColumn("p", F.lit(a) * F.exp(F.lit(decay) * F.col("dist")))
    fine = probs.groupBy("port").agg(F.sum("p").alias("total")).where("total < 1").select("port")
    return probs.join(fine, "port", "left_semi").select("port", "dest", "p")


def navigate(agents: DataFrame, table: DataFrame, env: DataFrame, seed: int, step: int) -> DataFrame:
    """Ships agents of ports that are not moving already; what probability is left stays. (The number of
    destinations is the port's own, where the reference takes its cell number.)"""
    ways = table.groupBy("port").agg(F.array_sort(F.collect_list(F.struct("dest", "p"))).alias("ways"))
    joined = agents.join(ways, F.col("cell") == F.col("port"), "left").join(env.select("cell", "ice"), "cell")
    r = u(seed, step, "ship", F.col("id"))
    walk = F.aggregate(
        F.coalesce("ways", F.array().cast("array<struct<dest:int,p:double>>")),
        F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("int").alias("d")),
        lambda s, w: F.struct((s["s"] + w["p"]).alias("s"), F.when(s["d"].isNull() & (r < s["s"] + w["p"]), w["dest"]).otherwise(s["d"]).alias("d")),
    )
    may = (F.col("life_state") > DEAD) & ((F.col("life_state").bitwiseAND(8)) == 0) & ~F.col("ice")
    return joined.withColumn("target", F.when(may, walk["d"])).drop("port", "ways", "ice")


def apply_moves(agents: DataFrame) -> DataFrame:
    """The new cell; the moving bit is cleared. (Agents that died in the same step do not move, unlike in the reference.)"""
    state = F.col("life_state").bitwiseAND(F.lit(~8))
    return agents.withColumns({"cell": F.coalesce("target", "cell"), "life_state": F.when(F.col("target").isNotNull(), state).otherwise(F.col("life_state"))})


def first_arrivals(moves: DataFrame, visited: DataFrame, dist: DataFrame, step: int) -> DataFrame:
    """Visited cells (``cell, hops, dist, time``) merged with arrivals (``source, target``) of a step.

    Only unvisited cells are entered: hops and distance from the source, the least distance wins
    (ties: fewer hops). ``dist`` has ``source, target, d``.
    """
    new = moves.select("source", "target").distinct().join(visited.select(F.col("cell").alias("target")), "target", "left_anti")
    came = new.join(visited.select(F.col("cell").alias("source"), "hops", F.col("dist").alias("from_dist")), "source").join(dist, ["source", "target"])
    best = came.groupBy("target").agg(F.min(F.struct((F.col("from_dist") + F.col("d")).alias("dist"), (F.col("hops") + 1).alias("hops"))).alias("b"))
    fresh = best.select(F.col("target").alias("cell"), F.col("b.hops").alias("hops"), F.col("b.dist").alias("dist"), F.lit(float(step)).alias("time"))
    return visited.unionByName(fresh)
