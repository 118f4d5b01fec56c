"""Queries of geometry and projections."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cohortspark.functions import projections as pj
from cohortspark.functions.curves import great_circle, great_circle_sql
from cohortspark.operators import raster as r
from cohortspark.operators import spatial
from cohortspark.plans import model as m
from cohortspark.registry import cte, query

D = f"{math.pi / 180!r}::DOUBLE"
cte("places", "SELECT c_custkey AS id, (c_custkey * 37 % 1400) / 10e0 - 70 AS lon, (c_custkey * 53 % 1200) / 10e0 - 55 AS lat FROM customer")


def places(spark, sf):
    i = F.col("c_custkey")
    return m.table(spark, sf, "customer").select(i.alias("id"), (i * 37 % 1400 / 10.0 - 70).alias("lon"), (i * 53 % 1200 / 10.0 - 55).alias("lat"))


@query("Q1_great_circle", f"SELECT id, round({great_circle_sql('lon', 'lat', '10e0', '20e0')}, 4) AS km FROM {{places}}")
def _(spark, sf):
    return places(spark, sf).select("id", F.round(great_circle(F.col("lon"), F.col("lat"), F.lit(10.0), F.lit(20.0)), 4).alias("km"))


@query("Q2_cartesian_distance", "SELECT id, round(sqrt((lon - 10) * (lon - 10) + (lat - 20) * (lat - 20)) * 2.5e0, 6) AS d FROM {places}")
def _(spark, sf):
    x, y = F.col("lon") - 10, F.col("lat") - 20
    return places(spark, sf).select("id", F.round(F.sqrt(x * x + y * y) * 2.5, 6).alias("d"))


@query("Q4_polar_cartesian", f"SELECT id, round(cos(lon * {D}) * cos(lat * {D}), 6) AS x, round(sin(lon * {D}) * cos(lat * {D}), 6) AS y, round(sin(lat * {D}), 6) AS z, round(lon, 6) AS lon, round(lat, 6) AS lat FROM {{places}}")
def _(spark, sf):
    xyz = pj.cartesian(F.col("lon"), F.col("lat"))
    lon, lat = pj.polar(*xyz)
    return places(spark, sf).select("id", *(F.round(c, 6).alias(n) for c, n in zip([*xyz, lon, lat], ["x", "y", "z", "lon", "lat"], strict=True)))


@query("Q3_slerp", f"""SELECT id, round(degrees(atan2(y, x)), 5) AS lon, round(degrees(asin(z)), 5) AS lat FROM (SELECT id, ax * p + bx * q AS x, ay * p + b_y * q AS y, az * p + bz * q AS z FROM (
  SELECT *, sin(arc * 0.7e0) / sin(arc) AS p, sin(arc * 0.3e0) / sin(arc) AS q FROM (SELECT *, acos(ax * bx + ay * b_y + az * bz) AS arc FROM (
  SELECT id, cos(lon * {D}) * cos(lat * {D}) AS ax, sin(lon * {D}) * cos(lat * {D}) AS ay, sin(lat * {D}) AS az, cos(100 * {D}) * cos(5 * {D}) AS bx, sin(100 * {D}) * cos(5 * {D}) AS b_y, sin(5 * {D}) AS bz FROM {{places}}))))""")
def _(spark, sf):
    lon, lat = pj.slerp(F.col("lon"), F.col("lat"), F.lit(100.0), F.lit(5.0), 0.3)
    return places(spark, sf).select("id", F.round(lon, 5).alias("lon"), F.round(lat, 5).alias("lat"))


LON0, LAT0 = 0.1, 0.3
P = {n: pj.Projection(n, LON0, LAT0, 0.4, 0.7) for n in pj.NAMES}
_d, _s0, _c0 = f"(l - {LON0}e0)", f"{math.sin(LAT0)!r}::DOUBLE", f"{math.cos(LAT0)!r}::DOUBLE"
_east, _north = f"cos(p) * sin({_d})", f"(sin(p) * {_c0} - cos(p) * cos({_d}) * {_s0})"
_to = f"(sin(p) * {_s0} + cos(p) * cos({_d}) * {_c0})"
_n, _f, _rho0 = (repr(v) + "::DOUBLE" for v in P["lcc"]._cone())
_rho = f"({_f} / pow(tan(p / 2 + {math.pi / 4!r}::DOUBLE), {_n}))"
FORWARD = {
    "eqr": (_d, f"p - {LAT0}e0"), "lin": ("l", "p"), "cea": (f"{_d} * {_c0}", f"sin(p) / {_c0}"), "tcea": (_east, f"atan(tan(p) / cos({_d})) - {LAT0}e0"),
    "ortho": (_east, _north), "ae": (f"{_east} * acos({_to}) / sin(acos({_to}))", f"{_north} * acos({_to}) / sin(acos({_to}))"),
    "laea": (f"{_east} * sqrt(2 / (1 + {_to}))", f"{_north} * sqrt(2 / (1 + {_to}))"), "lcc": (f"{_rho} * sin({_d} * {_n})", f"{_rho0} - {_rho} * cos({_d} * {_n})"),
}


def _projection(name: str) -> None:
    x, y = FORWARD[name]

    @query(f"Q5_{name}", f"SELECT id, round({x}, 5) AS x, round({y}, 5) AS y, round(l, 5) AS lon, round(p, 5) AS lat FROM (SELECT id, lon * {D} AS l, lat * {D} AS p FROM {{places}} WHERE abs(lon) < 60 AND abs(lat) < 50)")
    def _(spark, sf):
        """Forward, and the inverse of that, which has to be the place itself (the orthographic one shows one hemisphere)."""
        px, py = P[name].forward(F.radians("lon"), F.radians("lat"))
        flat = places(spark, sf).where("abs(lon) < 60 and abs(lat) < 50").select("id", px.alias("x"), py.alias("y"))
        lon, lat = P[name].inverse(F.col("x"), F.col("y"))
        return flat.select("id", *(F.round(c, 5).alias(n) for c, n in ((F.col("x"), "x"), (F.col("y"), "y"), (lon, "lon"), (lat, "lat"))))


for _name in pj.NAMES:
    _projection(_name)


@query("Q6_wrap", "SELECT id, round(lon * 5 - 360 * floor((lon * 5 + 180) / 360), 6) AS lon FROM {places}")
def _(spark, sf):
    return places(spark, sf).select("id", F.round(pj.wrap_longitude(F.col("lon") * 5), 6).alias("lon"))


@query("Q7_cell_geometry", f"SELECT g.cell, k, round({great_circle_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 4) AS dist, round(atan2(b.lat - a.lat, b.lon - a.lon), 6) AS angle FROM {{edges}} g JOIN {{cells}} a ON a.cell = g.cell JOIN {{cells}} b ON b.cell = g.nbr")
def _(spark, sf):
    c = m.cells(spark, sf)
    a, b = (c.select(F.col("cell").alias(k), F.col("lon").alias(p + "lon"), F.col("lat").alias(p + "lat")) for k, p in (("cell", "a"), ("nbr", "b")))
    g = m.edges(spark, sf).join(a, "cell").join(b, "nbr")
    ends = tuple(map(F.col, ("alon", "alat", "blon", "blat")))
    return g.select("cell", "k", F.round(great_circle(*ends), 4).alias("dist"), F.round(pj.bearing(*ends), 6).alias("angle"))


HOUSE = [(-50.0, -30.0), (20.0, -40.0), (45.0, 10.0), (0.0, 50.0), (-20.0, 0.0)]


def _polygon_sql() -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(HOUSE, HOUSE[1:] + HOUSE[:1], strict=True):
        parts.append(f"(({y1}e0 > lat) <> ({y2}e0 > lat) AND lon < (lat - {y1}e0) * {(x2 - x1) / (y2 - y1)!r}::DOUBLE + {x1}e0)::INT")
    return " + ".join(parts).replace("(-", "(-")


@query("P13_point_in_polygon", f"SELECT id, ({_polygon_sql()}) % 2 = 1 AS inside FROM {{places}}")
def _(spark, sf):
    return places(spark, sf).select("id", pj.in_polygon(F.col("lon"), F.col("lat"), HOUSE).alias("inside"))


@query("R16_reproject", """SELECT CAST(i // 10 AS INTEGER) AS y, CAST(i % 10 AS INTEGER) AS x, CASE WHEN v IS NULL OR isnan(v) THEN NULL ELSE round(v, 6) END AS v FROM (SELECT i, CAST(round(asin((i // 10 - 5.5e0) / 6) / 1.5707963267948966e0 * 6 + 5.5e0) AS INTEGER) AS sy FROM range(120) t(i)) LEFT JOIN {raster_a} a ON a.y = sy AND a.x = i % 10""")
def _(spark, sf):
    """From equirectangular to cylindrical equal-area: each target pixel is projected back and sampled."""
    grid = r.generate(spark, m.RASTER_H, m.RASTER_W, 0.0).select(F.col("y").alias("ty"), F.col("x").alias("tx"))
    _, lat = pj.Projection("cea").inverse(F.lit(0.0), (F.col("ty") - 5.5) / 6)
    at = grid.withColumns({"py": lat / (math.pi / 2) * 6 + 5.5, "px": F.col("tx").cast("double")})
    return r.sample(at, m.raster(spark, sf)).select(F.col("ty").alias("y"), F.col("tx").alias("x"), m.clean("v"))


@query("Q8_node_lookup", f"SELECT p.id, (min({{'d': round({great_circle_sql('p.lon', 'p.lat', 'c.lon', 'c.lat')}, 6), 'cell': c.cell}})).cell AS cell FROM {{places}} p, {{cells}} c GROUP BY p.id")
def _(spark, sf):
    """The nearest grid node, by bands that widen until each point has one."""
    return spatial.nearest(places(spark, sf), m.cells(spark, sf), "id", "cell", 800.0).select("id", "cell")


@query("Q8_geodesic_grid")
def _(spark, sf):
    """A geodesic grid with the number of neighbours of every node."""
    from cohortspark.operators.geodesic import geodesic_tables

    cells, edges = geodesic_tables(spark, 6)
    return cells.join(edges.groupBy("cell").agg(F.count("*").alias("n_neighbours")), "cell").select("cell", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "n_neighbours")
