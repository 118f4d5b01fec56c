"""Regions of cells: components of subsets, links by target, and growing regions."""

from __future__ import annotations

import hashlib
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.components import connected_components


def cell_components(edges: DataFrame, subset: DataFrame) -> DataFrame:
    """``cell, component`` of the subset's cells; a component is named by its least cell. Missing neighbours (-1) link nothing."""
    inside = subset.select("cell")
    e = edges.where("nbr >= 0").join(inside, "cell", "left_semi").join(inside.withColumnRenamed("cell", "nbr"), "nbr", "left_semi")
    parts = connected_components(e, "cell", "nbr")
    out = inside.join(parts, F.col("cell") == F.col("node"), "left")
    return out.select("cell", F.coalesce("component", "cell").alias("component"))


def sub_components(edges: DataFrame, components: DataFrame) -> DataFrame:
    """``component, target, n_cells``: a component's cells split by the other component they touch; links count once."""
    other = components.select(F.col("cell").alias("nbr"), F.col("component").alias("target"))
    touching = edges.where("nbr >= 0").join(components, "cell").join(other, "nbr").where("component <> target")
    return touching.groupBy("component", "target").agg(F.count_distinct("cell").alias("n_cells"))


def _draw(seed: int, *parts) -> float:
    return int(hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:8], 16) / 4294967296.0


def _grow(pdf: pd.DataFrame, n_regions: int, mode: str, seed: int) -> pd.DataFrame:
    around = {c: sorted(set(n for n in g["nbr"] if n >= 0)) for c, g in pdf.groupby("cell")}
    weight = dict(zip(pdf["cell"], pdf["n"], strict=True))
    region = {c: c for c in around}
    size = dict(weight)
    cells = {c: {c} for c in around}
    step = 0
    while len(size) > n_regions:
        step += 1
        smallest = min(size.values())
        ties = sorted(r for r, s in size.items() if s == smallest)
        r = ties[int(_draw(seed, step, "tie") * len(ties))]
        near = sorted({region[n] for c in cells[r] for n in around[c]} - {r})
        if not near:
            break
        take = {
            "all": near, "random": [near[int(_draw(seed, step, "near") * len(near))]],
            "smallest": [min(near, key=lambda x: (size[x], x))], "largest": [max(near, key=lambda x: (size[x], -x))],
        }[mode]
        for t in take:
            for c in cells.pop(t):
                region[c] = r
                cells[r].add(c)
            size[r] += size.pop(t)
    names = {r: min(c) for r, c in cells.items()}
    return pd.DataFrame([(c, names[region[c]], size[region[c]]) for c in sorted(around)], columns=["cell", "region", "n"])


def grow_regions(edges: DataFrame, counts: DataFrame, n_regions: int, mode: str = "smallest", seed: int = 1) -> DataFrame:
    """``cell, region, n``: the smallest region (ties at random) absorbs neighbours until ``n_regions`` are left.

    Each choice depends on the last one, so all cells (one row per edge of the grid) form one pandas group.
    """
    rows = edges.join(counts, "cell", "left").select("cell", "nbr", F.coalesce("n", F.lit(0)).alias("n"), F.lit(1).alias("one"))
    return rows.groupBy("one").applyInPandas(partial(_grow, n_regions=n_regions, mode=mode, seed=seed), "cell int, region int, n long")
