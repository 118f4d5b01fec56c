"""Ancestry graphs: traversal, coalescence, pruning, evolution. Rounds are joins; lineage is cut in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.lineage import cut
from cohortspark.operators.evolution import PIECE, evolved
from cohortspark.operators.genetics import BLOCK_BITS, random_mask


def parent_edges(ancestors: DataFrame) -> DataFrame:
    """``child, parent``; founders (0) have none."""
    both = F.explode(F.array("mom", "dad"))
    return ancestors.select(F.col("id").alias("child"), both.alias("parent")).where("parent > 0")


def parents_of(ancestors: DataFrame, ids: DataFrame) -> DataFrame:
    return ancestors.join(ids, "id", "left_semi").select("id", "mom", "dad")


def decode(packed: Column) -> tuple[Column, Column]:
    """(time, cell) of a packed long: time in the upper, cell in the lower 32 bits."""
    return F.shiftright(packed, 32), packed.bitwiseAND(F.lit(0xFFFFFFFF))


def back_reach(ancestors: DataFrame, start: DataFrame, hops: int = 6) -> DataFrame:
    """``origin, id, depth``: all ancestors of ``start`` (``origin, id``) with their least number of generations.

    A round goes ``hops`` generations up and looks once at what was reached before; each round's new
    nodes are a table of their own. It ends where nothing new is reached, however deep the graph is.
    """
    edges = cut(parent_edges(ancestors).distinct())
    frontier = cut(start.select("origin", "id", F.lit(0).alias("depth")).distinct())
    seen, depth = frontier, 0
    while True:
        up, reached = frontier.select("origin", "id"), None
        for hop in range(1, hops + 1):
            up = up.join(edges, F.col("id") == F.col("child")).select("origin", F.col("parent").alias("id")).distinct()
            now = up.withColumn("depth", F.lit(depth + hop))
            reached = now if reached is None else reached.unionByName(now)
        best = reached.groupBy("origin", "id").agg(F.min("depth").alias("depth"))
        new = cut(best.join(seen, ["origin", "id"], "left_anti"))
        depth += hops
        if new.isEmpty():
            return seen
        seen, frontier = seen.unionByName(new), new.where(F.col("depth") == depth)


def coalescence(ancestors: DataFrame, samples: DataFrame) -> DataFrame:
    """``a, b, time``: for each pair of samples the time of their most recent common ancestor (null: none)."""
    lines = back_reach(ancestors, samples.select(F.col("id").alias("origin"), "id"))
    times = lines.join(ancestors.select("id", "time"), "id").select("origin", "id", "time")
    common = times.select(F.col("origin").alias("a"), "id", "time").join(times.select(F.col("origin").alias("b"), "id"), "id").where("a < b")
    best = common.groupBy("a", "b").agg(F.max("time").alias("time"))
    s = samples.select(F.col("id").alias("a"))
    pairs = s.join(s.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))  # k samples make k (k - 1) / 2 rows of result
    return pairs.join(best, ["a", "b"], "left")


def prune_childless(ancestors: DataFrame, keep: DataFrame, rounds: int) -> DataFrame:
    """Drops, ``rounds`` times, all nodes without children that are not to be kept."""
    now = ancestors
    for _ in range(rounds):
        has_child = parent_edges(now).select(F.col("parent").alias("id")).distinct()
        stay = has_child.unionByName(keep.select("id")).distinct()
        now = cut(now.join(stay, "id", "left_semi"))
    return now


def lines_of(ancestors: DataFrame, survivors: DataFrame) -> DataFrame:
    """The nodes on lines to the survivors; ``progenitor`` marks those without parents."""
    reached = back_reach(ancestors, survivors.select(F.lit(0).alias("origin"), "id")).select("id")
    return ancestors.join(reached, "id", "left_semi").withColumn("progenitor", F.col("mom") == 0)


def merge_graphs(a: DataFrame, b: DataFrame) -> DataFrame:
    """``id, children`` of the union of two graphs."""
    edges = parent_edges(a).unionByName(parent_edges(b)).distinct()
    return edges.groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_set("child")).alias("children"))


def analyse(ancestors: DataFrame, block: int) -> DataFrame:
    """``block, least_parent, limit``: per block of ``block`` records in id order the smallest parent and the last id."""
    known = F.when(F.col("mom") > 0, F.least("mom", "dad"))
    return ancestors.groupBy(F.floor((F.col("id") - 1) / block).alias("block")).agg(F.min(known).alias("least_parent"), F.max("id").alias("limit"))


def evolve(ancestors: DataFrame, founders: DataFrame, blocks: int, seed: int, samples: DataFrame | None = None, size: int = PIECE) -> DataFrame:
    """``id, strand1, strand2`` of every node (of ``samples`` only, if given) whose founders all have genomes (``id, strand1, strand2``).

    A parent's strands recombine freely by a random mask; one result of each parent makes the child. So
    each bit comes from one strand of one parent, and is followed to a founder in pieces of about ``size`` nodes with
    neighbouring ids (``evolution.py``). Where ids do not go along with descent, so that most nodes have children
    in other pieces, all ways are doubled as rows.
    """
    parents = ancestors.where("mom > 0").select("id", "mom", "dad")
    own = founders.select("id", "strand1", "strand2")
    born = evolved(parents, own, blocks, seed, samples, size)
    if born is None:
        born = _doubled(parents.join(own, "id", "left_anti"), own, blocks, seed)
        born = born if samples is None else born.join(samples.select("id"), "id", "left_semi")
    own = own if samples is None else own.join(samples.select("id"), "id", "left_semi")
    return own.unionByName(born)


def _doubled(parents: DataFrame, founders: DataFrame, blocks: int, seed: int) -> DataFrame:
    """The same for any order of ids: a row per node, strand, block and origin holds the bits that go there, and following
    two steps at once doubles the way in each round. A graph of d generations takes log2(d) rounds, whatever its size.
    """
    mask = lambda p: random_mask(f"{seed}|evolve|{p}", F.col("id"), blocks)
    full = (1 << BLOCK_BITS) - 1
    sides = F.array(F.struct(F.lit(1).alias("s"), F.col("mom").alias("to"), mask("mom").alias("m")), F.struct(F.lit(2).alias("s"), F.col("dad").alias("to"), mask("dad").alias("m")))
    strands = parents.select("id", F.inline(sides)).select("id", "s", "to", F.posexplode("m").alias("b", "bits"))
    ways = F.array(F.struct(F.lit(1).alias("ts"), F.col("bits").alias("bits")), F.struct(F.lit(2).alias("ts"), (F.lit(full).cast("bigint") - F.col("bits")).alias("bits")))
    ways = strands.select("id", "s", "b", "to", F.inline(ways)).where("bits <> 0")
    inner = parents.select(F.col("id").alias("to"), F.lit(False).alias("ends"))
    ways = cut(ways.join(inner, "to", "left").select("id", "s", "b", "bits", "to", "ts", F.coalesce("ends", F.lit(True)).alias("ends")))
    while not ways.where("not ends").isEmpty():
        on = ways.select(F.col("id").alias("to"), F.col("s").alias("ts"), "b", F.col("bits").alias("more"), F.col("to").alias("to2"), F.col("ts").alias("ts2"), F.col("ends").alias("ends2"))
        far = ways.where("not ends").join(on, ["to", "ts", "b"]).select(
            "id", "s", "b", F.col("bits").bitwiseAND(F.col("more")).alias("bits"), F.col("to2").alias("to"), F.col("ts2").alias("ts"), F.col("ends2").alias("ends")
        )
        far = far.where("bits <> 0").groupBy("id", "s", "b", "to", "ts", "ends").agg(F.bit_or("bits").alias("bits"))
        ways = cut(ways.where("ends").unionByName(far.select(*ways.columns)))
    known = founders.select(F.col("id").alias("to"), F.inline(F.array(F.struct(F.lit(1).alias("ts"), F.col("strand1").alias("v")), F.struct(F.lit(2).alias("ts"), F.col("strand2").alias("v")))))
    known = known.select("to", "ts", F.posexplode("v").alias("b", "value"))
    made = ways.join(known, ["to", "ts", "b"]).groupBy("id", "s", "b").agg(F.bit_or(F.col("value").bitwiseAND(F.col("bits"))).alias("value"), F.bit_or("bits").alias("all"))
    whole = made.where(F.col("all") == full).groupBy("id").agg(F.count("*").alias("n"), *(F.transform(F.sort_array(F.collect_list(F.when(F.col("s") == s, F.struct("b", "value")))), lambda e: e["value"]).alias(f"strand{s}") for s in (1, 2)))
    return whole.where(F.col("n") == 2 * blocks).select("id", "strand1", "strand2")


def sampled_genomes(ancestors: DataFrame, founders: DataFrame, samples: DataFrame, blocks: int, seed: int) -> DataFrame:
    """``id, strand1, strand2`` of the samples. Their lines are not cut out before: that takes more joins over the whole
    graph than evolving it takes arrays; only samples leave the arrays."""
    return evolve(ancestors, founders, blocks, seed, samples)
