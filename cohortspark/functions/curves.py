"""Piecewise-linear functions and environmental formulas as columns (and as SQL text)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def polyline(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between knots, constant outside them; the identity without a segment."""
    if len(knots) < 2:
        return x
    out = F.when(x <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, v0), (x1, v1) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= x1, F.lit(float(v0)) + (x - x0) * ((v1 - v0) / (x1 - x0)))
    return out.otherwise(F.lit(float(knots[-1][1])))


def polyline_sql(x: str, knots: list[tuple[float, float]]) -> str:
    if len(knots) < 2:
        return x
    parts = [f"WHEN {x} <= {knots[0][0]} THEN {float(knots[0][1])!r}::DOUBLE"]
    for (x0, v0), (x1, v1) in zip(knots, knots[1:], strict=False):
        parts.append(f"WHEN {x} <= {x1} THEN {float(v0)!r}::DOUBLE + ({x} - {float(x0)!r}::DOUBLE) * {(v1 - v0) / (x1 - x0)!r}::DOUBLE")
    return f"CASE {' '.join(parts)} ELSE {float(knots[-1][1])!r}::DOUBLE END"


def npp_miami(temp: Column, rain: Column) -> Column:
    """Net primary production by the Miami model: the lesser of two saturating curves."""
    warm = F.lit(3000.0) / (1 + F.exp(F.lit(1.315) - F.lit(0.119) * temp))
    wet = F.lit(3000.0) * (1 - F.exp(F.lit(-0.000664) * rain))
    return F.least(warm, wet)


NPP_MIAMI_SQL = "least(3000.0 / (1 + exp(1.315 - 0.119 * temp)), 3000.0 * (1 - exp(-0.000664 * rain)))"


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371.3) -> Column:
    """Distance on the sphere by the arc cosine of the dot product, clamped to [-1, 1]; degrees in."""
    r = math.pi / 180
    dot = F.sin(lat1 * r) * F.sin(lat2 * r) + F.cos(lat1 * r) * F.cos(lat2 * r) * F.cos((lon1 - lon2) * r)
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot))) * radius


def great_circle_sql(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = 6371.3) -> str:
    r = repr(math.pi / 180) + "::DOUBLE"
    dot = f"sin({lat1} * {r}) * sin({lat2} * {r}) + cos({lat1} * {r}) * cos({lat2} * {r}) * cos(({lon1} - {lon2}) * {r})"
    return f"(acos(least(1.0, greatest(-1.0, {dot}))) * {radius})"
