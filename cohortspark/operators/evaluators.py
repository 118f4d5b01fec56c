"""Cell-level evaluators: weights of moving, carrying capacity, climate and production."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.curves import npp_miami, polyline
from cohortspark.operators.grid import cumulated, with_neighbour_values

MODES = ("add", "add_block", "add_simple", "mul", "max", "max_block", "max_simple", "min")


def single_evaluator(edges: DataFrame, env: DataFrame, column: str, knots: list[tuple[float, float]], cumulate: bool = True) -> DataFrame:
    """``cell, k, nbr, value[, cum]``: a curve of one layer, never negative, 0 on ice, for the cell and its neighbours."""
    score = F.when(F.col("ice"), F.lit(0.0)).otherwise(F.greatest(polyline(F.col(column), knots), F.lit(0.0)))
    weights = with_neighbour_values(edges, env.select("cell", score.alias("w")), "w")
    return cumulated(weights) if cumulate else weights


def multi_evaluator(parts: list[tuple[DataFrame, float]], mode: str) -> DataFrame:
    """Combines raw evaluators (``cell, k, nbr, value``) with weights; all but the simple modes are cumulated.

    The block modes give 0 wherever any factor is 0 or less.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    weighted = [p.select("cell", "k", "nbr", F.col("value").alias("raw"), (F.col("value") * w).alias("v")) for p, w in parts]
    rows = reduce(DataFrame.unionByName, weighted)
    total = {
        "add": F.sum("v"), "mul": F.product("v"), "max": F.max("v"), "min": F.min("v"),
    }[mode.split("_")[0]]
    if mode.endswith("block"):
        total = F.when(F.min("raw") <= 0, F.lit(0.0)).otherwise(total)
    out = rows.groupBy("cell", "k", "nbr").agg(total.alias("value"))
    return out if mode.endswith("simple") else cumulated(out)


def capacity(env: DataFrame, k_min: float = 5.0, k_max: float = 60.0, npp_min: float = 100.0, npp_max: float = 1400.0, coast: float = 1.3, water: float = 0.5) -> DataFrame:
    """``cell, capacity`` from production: high ground thins out between 1500 and 2500 m, missing values fall back
    to the Miami formula, a linear ramp between the bounds, bonuses for coast and fresh water, clamped to the top."""
    npp = F.when(F.col("npp") > 0, F.col("npp")).otherwise(npp_miami(F.col("temp"), F.col("rain")))
    thin = F.when(F.col("altitude") >= 2500, 0.0).when(F.col("altitude") > 1500, (F.lit(2500.0) - F.col("altitude")) / 1000).otherwise(1.0)
    eff = npp * thin
    ramp = F.when(eff <= npp_min, 0.0).when(eff >= npp_max, k_max).otherwise(F.lit(k_min) + (k_max - k_min) * (eff - npp_min) / (npp_max - npp_min))
    bonus = F.when(F.col("coastal"), F.lit(coast)).otherwise(F.lit(1.0)) * (1 + F.col("water") * water)
    land = (F.col("altitude") >= 0) & ~F.col("ice")
    return env.select("cell", F.when(land, F.least(ramp * bonus, F.lit(k_max))).otherwise(F.lit(0.0)).alias("capacity"))


def npp_by_cover(grass: Column, bush: Column, tree: Column) -> Column:
    """Production as weighted plant covers; weights are the reference's stored growth rates (fixed values)."""
    return grass * 0.611427 + bush * 0.362280 + tree * 2.456798


def season_climate(env: DataFrame, diffs: list[float], ratios: list[float], season: int) -> DataFrame:
    """Actual temperature is the annual mean plus the season's difference, rain the annual total times its ratio;
    without seasons the annual values."""
    d = diffs[season % len(diffs)] if diffs else 0.0
    r = ratios[season % len(ratios)] if ratios else 1.0
    return env.withColumns({"act_temp": F.col("temp") + F.lit(d), "act_rain": F.col("rain") * F.lit(r)})
