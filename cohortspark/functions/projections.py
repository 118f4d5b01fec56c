"""Map projections of the unit sphere as column functions, forward and inverse; angles in radians.

Standard formulas (equirectangular, linear, cylindrical and transverse cylindrical equal-area,
orthographic, azimuthal equidistant, Lambert azimuthal equal-area, Lambert conformal conic).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("eqr", "lin", "cea", "tcea", "ortho", "ae", "laea", "lcc")


@dataclass(frozen=True)
class Projection:
    name: str
    lon0: float = 0.0
    lat0: float = 0.0
    lat1: float = 0.0
    lat2: float = 0.0

    def _cone(self) -> tuple[float, float, float]:
        """Constants of the conic: n, F, rho0."""
        half = lambda a: math.tan(math.pi / 4 + a / 2)
        if self.lat1 == self.lat2:
            n = math.sin(self.lat1)
        else:
            n = math.log(math.cos(self.lat1) / math.cos(self.lat2)) / math.log(half(self.lat2) / half(self.lat1))
        f = math.cos(self.lat1) * half(self.lat1) ** n / n
        return n, f, f / half(self.lat0) ** n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        s0, c0, d = math.sin(self.lat0), math.cos(self.lat0), lon - self.lon0
        if self.name == "eqr":
            return d, lat - self.lat0
        if self.name == "lin":
            return lon, lat
        if self.name == "cea":
            return d * c0, F.sin(lat) / c0
        if self.name == "tcea":
            return F.cos(lat) * F.sin(d), F.atan(F.tan(lat) / F.cos(d)) - self.lat0
        if self.name == "lcc":
            n, f, rho0 = self._cone()
            rho = F.lit(f) / F.pow(F.tan(lat / 2 + math.pi / 4), F.lit(n))
            return rho * F.sin(d * n), F.lit(rho0) - rho * F.cos(d * n)
        east = F.cos(lat) * F.sin(d)
        north = F.sin(lat) * c0 - F.cos(lat) * F.cos(d) * s0
        towards = F.sin(lat) * s0 + F.cos(lat) * F.cos(d) * c0  # cosine of the arc to the centre
        if self.name == "ortho":
            return east, north
        if self.name == "laea":
            k = F.sqrt(F.lit(2.0) / (towards + 1))
        else:
            arc = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), towards)))
            k = F.when(arc < 1e-12, F.lit(1.0)).otherwise(arc / F.when(arc < 1e-12, F.lit(1.0)).otherwise(F.sin(arc)))
        return east * k, north * k

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        s0, c0 = math.sin(self.lat0), math.cos(self.lat0)
        if self.name == "eqr":
            return x + self.lon0, y + self.lat0
        if self.name == "lin":
            return x, y
        if self.name == "cea":
            return x / c0 + self.lon0, F.asin(y * c0)
        if self.name == "tcea":
            flat, up = F.sqrt(F.lit(1.0) - x * x), y + self.lat0
            return F.atan2(x, flat * F.cos(up)) + self.lon0, F.asin(flat * F.sin(up))
        if self.name == "lcc":
            n, f, rho0 = self._cone()
            rho = F.sqrt(x * x + (F.lit(rho0) - y) * (F.lit(rho0) - y)) * math.copysign(1.0, n)
            sign = math.copysign(1.0, n)
            return F.atan2(x * sign, (F.lit(rho0) - y) * sign) / n + self.lon0, F.atan(F.pow(F.lit(f) / rho, F.lit(1 / n))) * 2 - math.pi / 2
        rho = F.sqrt(x * x + y * y)
        arc = {"ortho": F.asin(F.least(rho, F.lit(1.0))), "laea": F.asin(F.least(rho / 2, F.lit(1.0))) * 2, "ae": rho}[self.name]
        centre = rho < 1e-12
        safe = F.when(centre, F.lit(1.0)).otherwise(rho)
        lat = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.cos(arc) * s0 + y * F.sin(arc) * c0 / safe)))
        lon = F.atan2(x * F.sin(arc), rho * c0 * F.cos(arc) - y * s0 * F.sin(arc)) + self.lon0
        return F.when(centre, F.lit(self.lon0)).otherwise(lon), F.when(centre, F.lit(self.lat0)).otherwise(lat)


def cartesian(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Unit vector of a place in degrees."""
    a, b = F.radians(lon), F.radians(lat)
    return F.cos(a) * F.cos(b), F.sin(a) * F.cos(b), F.sin(b)


def polar(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Degrees of a unit vector."""
    return F.degrees(F.atan2(y, x)), F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), z))))


def slerp(lon1: Column, lat1: Column, lon2: Column, lat2: Column, t: float) -> tuple[Column, Column]:
    """The place a fraction ``t`` along the great circle; ends must not be antipodes."""
    a, b = cartesian(lon1, lat1), cartesian(lon2, lat2)
    dot = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), a[0] * b[0] + a[1] * b[1] + a[2] * b[2]))
    arc = F.acos(dot)
    same = arc < 1e-12
    safe = F.when(same, F.lit(1.0)).otherwise(F.sin(arc))
    p, q = F.sin(arc * (1 - t)) / safe, F.sin(arc * t) / safe
    mixed = [F.when(same, x).otherwise(x * p + y * q) for x, y in zip(a, b, strict=True)]
    return polar(*mixed)


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Direction of a neighbour as the angle of (dlon, dlat); undefined (NaN) at a pole."""
    pole = (F.abs(lat1) >= 90) | (F.abs(lat2) >= 90)
    return F.when(pole, F.lit(float("nan"))).otherwise(F.atan2(lat2 - lat1, lon2 - lon1))


def wrap_longitude(lon: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point is inside: an odd number of edges cross the ray to the right."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 != y2:
            spans = (F.lit(y1) > y) != (F.lit(y2) > y)
            at = (y - y1) * ((x2 - x1) / (y2 - y1)) + x1
            crossings = crossings + (spans & (x < at)).cast("int")
    return crossings % 2 == 1
