"""Scalar mathematics as columns: gamma and beta functions, prime factors, quaternions, units."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gammaln(x: Column) -> Column:
    """ln of the gamma function for x > 0: the asymptotic series at x + 8, stepped back by the recurrence."""
    z = x + 8.0
    terms = ((-1.0 / 12, 1), (1.0 / 360, 3), (-1.0 / 1260, 5), (1.0 / 1680, 7), (-1.0 / 1188, 9))
    series = F.lit(0.0)
    for c, power in terms:
        series = series - F.lit(c) / F.pow(z, F.lit(float(power)))
    steps = F.lit(0.0)
    for k in range(8):
        steps = steps + F.log(x + float(k))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - steps


def beta(a: Column, b: Column) -> Column:
    """The beta function."""
    return F.exp(gammaln(a) + gammaln(b) - gammaln(a + b))


def prime_factors(n: Column) -> Column:
    """The prime factors of a number from 1 on in ascending order, by trial division up to its root."""
    root = F.greatest(F.floor(F.sqrt(n.cast("double"))).cast("bigint"), F.lit(2).cast("bigint"))
    kind = "struct<rest:bigint,found:array<bigint>>"

    def split(state: Column, d: Column) -> Column:
        """All of one divisor at once: its power is at most the number's logarithm."""
        powers = F.aggregate(
            F.sequence(F.lit(1), F.lit(62)), F.struct(state["rest"].alias("r"), F.lit(0).alias("k")),
            lambda s, _: F.when(s["r"] % d == 0, F.struct((s["r"] / d).cast("bigint").alias("r"), (s["k"] + 1).alias("k"))).otherwise(s),
        )
        divided = F.struct(powers["r"].alias("rest"), F.concat(state["found"], F.array_repeat(d, powers["k"])).alias("found")).cast(kind)
        return F.when(state["rest"] % d == 0, divided).otherwise(state)

    start = F.struct(n.cast("bigint").alias("rest"), F.array().cast("array<bigint>").alias("found")).cast(kind)
    done = F.aggregate(F.sequence(F.lit(2).cast("bigint"), root), start, split)
    return F.when(done["rest"] > 1, F.concat(done["found"], F.array(done["rest"]))).otherwise(done["found"])


def rotation(axis: tuple[float, float, float], angle: Column) -> Column:
    """The quaternion (w, x, y, z) that turns by ``angle`` around an axis."""
    norm = math.sqrt(sum(a * a for a in axis))
    parts = [F.cos(angle / 2), *(F.sin(angle / 2) * (a / norm) for a in axis)]
    return F.struct(*(p.alias(n) for p, n in zip(parts, "wxyz", strict=True)))


def multiply(p: Column, q: Column) -> Column:
    """The product of two quaternions."""
    w = p["w"] * q["w"] - p["x"] * q["x"] - p["y"] * q["y"] - p["z"] * q["z"]
    x = p["w"] * q["x"] + p["x"] * q["w"] + p["y"] * q["z"] - p["z"] * q["y"]
    y = p["w"] * q["y"] - p["x"] * q["z"] + p["y"] * q["w"] + p["z"] * q["x"]
    z = p["w"] * q["z"] + p["x"] * q["y"] - p["y"] * q["x"] + p["z"] * q["w"]
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))


def turned(q: Column, x: Column, y: Column, z: Column) -> Column:
    """A vector turned by a unit quaternion."""
    v = F.struct(F.lit(0.0).alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))
    back = F.struct(q["w"].alias("w"), (-q["x"]).alias("x"), (-q["y"]).alias("y"), (-q["z"]).alias("z"))
    return multiply(multiply(q, v), back)


#: Units in terms of metre, gram, second and kelvin.
UNITS = {
    "m": 1.0, "km": 1e3, "cm": 1e-2, "mm": 1e-3, "ha": 1e4, "l": 1e-3, "g": 1.0, "kg": 1e3, "mg": 1e-3, "t": 1e6,
    "s": 1.0, "min": 60.0, "h": 3600.0, "d": 86400.0, "y": 31556952.0, "K": 1.0,
}


def unit_factor(text: str) -> float:
    """The factor of a product of units with exponents (``kg m^-2 * s^1.5``); 0 for an unknown unit."""
    factor = 1.0
    for part in text.replace("*", " ").split():
        name, _, power = part.partition("^")
        if name not in UNITS:
            return 0.0
        factor *= UNITS[name] ** (float(power) if power else 1.0)
    return factor
