"""Spatial joins: radius, nearest, lattice and range joins over bands of latitude."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.curves import great_circle
from cohortspark.functions.lineage import cut

KM_PER_DEGREE = math.pi / 180 * 6371.3


def radius_join(points: DataFrame, places: DataFrame, max_dist: float, within: str | float) -> DataFrame:
    """Every (point, place) closer than ``within`` (a column of places, at most ``max_dist``).

    Both sides get a band of latitude as high as ``max_dist``; places stand in three bands, so the
    join is an equi-join with an exact filter. Columns of places must not clash with those of points
    but for ``lon, lat``; the result has ``d``.
    """
    height = max(max_dist / KM_PER_DEGREE, 1e-6)
    band = lambda c: F.floor(F.col(c) / height)
    p = points.withColumn("__band", band("lat"))
    q = places.withColumnsRenamed({"lon": "__lon", "lat": "__lat"})
    q = q.withColumn("__band", F.explode(F.sequence(band("__lat") - 1, band("__lat") + 1)))
    joined = p.join(q, "__band").withColumn("d", great_circle(F.col("lon"), F.col("lat"), F.col("__lon"), F.col("__lat")))
    limit = F.col(within) if isinstance(within, str) else F.lit(within)
    return joined.where(F.col("d") < limit).drop("__band", "__lon", "__lat")


def first_place(found: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Of the matches of a point, the first place by name (the serial rule)."""
    w = Window.partitionBy(*keys).orderBy(name)
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def nearest_within(points: DataFrame, places: DataFrame, key: str, place: str, radius: float) -> DataFrame:
    """``key, place, d`` of the nearest place within the radius (ties: the smaller place); -1 if there is none."""
    near = radius_join(points.select(key, "lon", "lat"), places.select(F.col(place).alias("__place"), "lon", "lat"), radius, radius)
    best = near.groupBy(key).agg(F.min(F.struct("d", "__place")).alias("b"))
    out = points.select(key).join(best, key, "left")
    return out.select(key, F.coalesce("b.__place", F.lit(-1)).alias(place), F.coalesce("b.d", F.lit(-1.0)).alias("d"))


def nearest(points: DataFrame, places: DataFrame, key: str, place: str, first_radius: float, decimals: int = 6) -> DataFrame:
    """``key, place, d`` of each point's nearest place (distances that agree in ``decimals`` are ties: the smaller place).

    Points that have no place within the radius are asked again with twice the radius, until it has
    passed half the globe; so any number of places is joined by bands. No places: no rows.
    """
    left, told, radius = cut(points.select(key, "lon", "lat")), None, first_radius
    stops = places.select(F.col(place).alias("__place"), "lon", "lat")
    if stops.isEmpty():
        return left.select(key, F.lit(-1).alias(place), F.lit(-1.0).alias("d")).where("false")
    while True:
        last = radius > math.pi * 6371.3 * 1.01
        near = radius_join(left, stops, radius, radius).withColumn("d", F.round("d", decimals))
        best = near.groupBy(key).agg(F.min(F.struct("d", "__place")).alias("b"))
        found = cut(best.where(F.lit(last) | (F.col("b.d") < radius - 10.0**-decimals)).select(key, F.col("b.__place").alias(place), F.col("b.d").alias("d")))
        told = found if told is None else told.unionByName(found)
        left = cut(left.join(found, key, "left_anti"))
        if last or left.isEmpty():
            return told
        radius *= 2


def snap(points: DataFrame, step: float, radius: float) -> DataFrame:
    """Points within ``radius`` of their nearest lattice point, with ``glon, glat``."""
    at = points.withColumns({"glon": F.round(F.col("lon") / step) * step, "glat": F.round(F.col("lat") / step) * step})
    return at.where(great_circle(F.col("lon"), F.col("lat"), F.col("glon"), F.col("glat")) < radius)


def range_pairs(points: DataFrame, key: str, max_dist: float) -> DataFrame:
    """``a, b, d`` with a < b: all pairs closer than ``max_dist``, by bands of latitude."""
    q = points.select(F.col(key).alias("b"), "lon", "lat")
    found = radius_join(points.select(F.col(key).alias("a"), "lon", "lat"), q, max_dist, max_dist)
    return found.where("a < b").select("a", "b", "d")


def mutual_shortest_links(links: DataFrame) -> DataFrame:
    """``src, dst, d`` of ``src, dst, src_comp, dst_comp, d`` (both directions): per source and target
    component the shortest link, kept if it is also the other end's shortest one."""
    best = links.where("src_comp <> dst_comp").groupBy("src", "src_comp", "dst_comp").agg(F.min(F.struct("d", "dst")).alias("b"))
    best = best.select("src", F.col("b.dst").alias("dst"), F.col("b.d").alias("d"))
    back = best.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return best.join(back, ["src", "dst"], "left_semi")
