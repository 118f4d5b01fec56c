"""Lattice and adjacency: cells as numbers, neighbours as arithmetic, weights as prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rectangular neighbours in order: left, up, right, down.
RECT = ((-1, 0), (0, -1), (1, 0), (0, 1))
#: Hexagonal neighbours (odd rows are set half a cell to the right), from west clockwise.
HEX_EVEN = ((-1, 0), (-1, -1), (0, -1), (1, 0), (0, 1), (-1, 1))
HEX_ODD = ((-1, 0), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1))


def lattice_edges(cells: DataFrame, width: int, height: int, periodic: bool, hexagonal: bool = False) -> DataFrame:
    """``cell, k, nbr`` of every cell (columns ``cell, x, y``); -1 where a border has no neighbour."""
    steps = range(6 if hexagonal else 4)

    def place(k: int) -> Column:
        def at(dx: int, dy: int) -> Column:
            x, y = F.col("x") + dx, F.col("y") + dy
            if periodic:
                return F.pmod(y, F.lit(height)) * width + F.pmod(x, F.lit(width))
            inside = x.between(0, width - 1) & y.between(0, height - 1)
            return F.when(inside, y * width + x).otherwise(F.lit(-1))

        if not hexagonal:
            return at(*RECT[k])
        return F.when(F.col("y") % 2 == 0, at(*HEX_EVEN[k])).otherwise(at(*HEX_ODD[k]))

    all_places = F.array(*(place(k).cast("int") for k in steps))
    return cells.select("cell", F.posexplode(all_places).alias("k", "nbr"))


def with_neighbour_values(edges: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """``cell, k, nbr, value``: the neighbour's value; 0 for a missing neighbour. k = -1 is the cell itself."""
    own = edges.select("cell").distinct().select("cell", F.lit(-1).alias("k"), F.col("cell").alias("nbr"))
    sided = edges.select("cell", "k", "nbr").unionByName(own)
    v = values.select(F.col("cell").alias("nbr"), F.col(column).cast("double").alias("value"))
    return sided.join(v, "nbr", "left").select("cell", "k", "nbr", F.coalesce("value", F.lit(0.0)).alias("value"))


def cumulated(weights: DataFrame, value: str = "value") -> DataFrame:
    """Running sums of non-negative weights over [self, neighbours...] of each cell."""
    w = Window.partitionBy("cell").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return weights.withColumn("cum", F.sum(F.greatest(F.col(value), F.lit(0.0))).over(w))


def draw_from(cum: DataFrame, draws: DataFrame) -> DataFrame:
    """``draws`` (``id, cell, r`` with r in [0, 1)) with the place ``k`` and cell ``nbr`` drawn by weight.

    The tables are folded into one row per cell (its degree is small and fixed), so each agent
    needs one equi-join; no weight at all draws the cell itself.
    """
    tables = cum.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("k", "nbr", "cum"))).alias("t"))
    total = F.element_at("t", -1)["cum"]
    hit = F.filter("t", lambda e: F.col("r") * total < e["cum"])
    chosen = F.when(total > 0, F.get(hit, F.lit(0)))
    out = draws.join(tables, "cell").withColumn("e", chosen)
    return out.select(*draws.columns, F.coalesce("e.k", F.lit(-1)).alias("k"), F.coalesce("e.nbr", "cell").alias("nbr"))
