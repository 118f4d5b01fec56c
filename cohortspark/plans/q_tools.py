"""Queries of the tools around the model: sinks of rasters, imports into cells, lists of places, scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cohortspark.functions import projections as pj
from cohortspark.functions import scalars as sc
from cohortspark.operators import ancestry as an
from cohortspark.operators import raster as r
from cohortspark.plans import model as m
from cohortspark.plans.q_geo import HOUSE, _polygon_sql
from cohortspark.registry import cte, query

SHOWN = "CASE WHEN isnan(v) THEN 'nan' ELSE printf('%.6f', v) END"


@query("S15_raster_lines", f"SELECT y, string_agg({SHOWN}, ' ' ORDER BY x) AS line FROM {{raster_a}} GROUP BY y")
def _(spark, sf):
    return r.text_lines(m.raster(spark, sf))


@query("S15_raster_triples", f"SELECT printf('%.6f', x * 36e0 - 180) || chr(9) || printf('%.6f', y * 15e0 - 90) || chr(9) || {SHOWN} AS value FROM {{raster_a}}")
def _(spark, sf):
    return r.text_triples(m.raster(spark, sf), -180.0, 36.0, -90.0, 15.0)


cte("routes", "SELECT source, target, count(*) AS n FROM {moves} WHERE source <> target GROUP BY source, target")
cte("traced", """SELECT r.n, CAST(round(a.x + (b.x - a.x) * (i / 16e0)) AS INTEGER) AS x, CAST(round(a.y + (b.y - a.y) * (i / 16e0)) AS INTEGER) AS y
  FROM {routes} r JOIN {cells} a ON a.cell = source JOIN {cells} b ON b.cell = target, range(17) t(i)""")


@query("S19_lines_to_cells", "SELECT CAST(y * 5 + x AS INTEGER) AS cell, max(n) AS most, count(*) AS points FROM {traced} GROUP BY 1")
def _(spark, sf):
    """Routes as lines over the lattice: each cell gets the largest value of the lines that pass it."""
    c = m.cells(spark, sf)
    moves = m.moves(spark, sf).where("source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))
    a, b = (c.select(F.col("cell").alias(k), F.col("x").cast("double").alias(f"x{i}"), F.col("y").cast("double").alias(f"y{i}")) for i, k in enumerate(("source", "target")))
    at = r.trace(moves.join(a, "source").join(b, "target"), 16)
    return at.groupBy((F.col("y") * m.SIDE + F.col("x")).alias("cell")).agg(F.max("n").alias("most"), F.count("*").alias("points"))


@query("S27_grid_preparation", """SELECT cell, CASE WHEN isnan(v) THEN NULL ELSE round(v, 6) END AS value FROM (SELECT p.cell, sum(CASE WHEN w > 0 THEN coalesce(a.v, 'nan'::DOUBLE) * w ELSE 0e0 END) AS v FROM (
  SELECT cell, CAST(floor(py) AS INTEGER) + j AS y, CAST(floor(px) AS INTEGER) + i AS x, (CASE WHEN j = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE WHEN i = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS w
  FROM (SELECT cell, (lat + 25) / 6e0 AS py, (lon + 25) / 7e0 AS px FROM {cells}), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(j, i)) p LEFT JOIN {raster_a} a ON a.y = p.y AND a.x = p.x GROUP BY p.cell)""")
def _(spark, sf):
    """A raster layer interpolated to the places of the cells."""
    at = m.cells(spark, sf).select("cell", ((F.col("lat") + 25) / 6.0).alias("py"), ((F.col("lon") + 25) / 7.0).alias("px"))
    return r.sample(at, m.raster(spark, sf), "bilinear").select("cell", m.clean("v").alias("value"))


@query("E20_location_list", f"SELECT 'house' AS name, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, count(*) AS n FROM {{places}} WHERE ({_polygon_sql()}) % 2 = 1")
def _(spark, sf):
    """The places of a region's polygon as one location: its middle and how many there are."""
    from cohortspark.plans.q_geo import places

    inside = places(spark, sf).where(pj.in_polygon(F.col("lon"), F.col("lat"), HOUSE))
    return inside.agg(F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"), F.count("*").alias("n")).select(F.lit("house").alias("name"), "lon", "lat", "n")


@query("N9_sampled_genomes")
def _(spark, sf):
    """Sampling and evolving in one: only the lines to the sample (ids divisible by 50) are evolved."""
    a = m.ancestors(spark, sf)
    founders = a.where("mom = 0").join(m.genomes(spark, sf), "id").select("id", "strand1", "strand2")
    return an.sampled_genomes(a, founders, a.where("id % 50 = 0").select("id"), 3, 11)


@query("F5_gamma_beta", "SELECT c_custkey, round(lgamma((c_custkey + 1) / 7e0), 5) AS g, round(exp(lgamma(1 + c_custkey % 9) + lgamma(2.5e0) - lgamma(3.5e0 + c_custkey % 9)), 8) AS b FROM customer")
def _(spark, sf):
    k = F.col("c_custkey")
    return m.table(spark, sf, "customer").select("c_custkey", F.round(sc.gammaln((k + 1) / 7.0), 5).alias("g"), F.round(sc.beta((1 + k % 9).cast("double"), F.lit(2.5)), 8).alias("b"))


@query("F6_prime_factors", """SELECT n, string_agg(p, ' ' ORDER BY p, k) AS factors FROM (SELECT n, p, k FROM (SELECT c_custkey AS n FROM customer WHERE c_custkey > 1) c,
  (SELECT a AS p FROM range(2, (SELECT max(c_custkey) + 1 FROM customer)) x(a) WHERE NOT EXISTS (SELECT 1 FROM range(2, 400) y(b) WHERE b < a AND b * b <= a AND a % b = 0)) primes, range(1, 21) e(k)
  WHERE p <= n AND n % p = 0 AND p ** k <= n AND n % CAST(least(p ** k, 1e15) AS BIGINT) = 0) GROUP BY n""")
def _(spark, sf):
    n = m.table(spark, sf, "customer").where("c_custkey > 1").select(F.col("c_custkey").alias("n"))
    return n.select("n", F.array_join(F.transform(sc.prime_factors(F.col("n")), lambda p: p.cast("string")), " ").alias("factors"))


def _turn_sql() -> str:
    """Rodrigues' formula around (1, 2, 2) / 3 for the vector (lon, lat, 1)."""
    k, v = ("(1 / 3e0)", "(2 / 3e0)", "(2 / 3e0)"), ("lon", "lat", "1e0")
    cross = [f"({k[1]} * {v[2]} - {k[2]} * {v[1]})", f"({k[2]} * {v[0]} - {k[0]} * {v[2]})", f"({k[0]} * {v[1]} - {k[1]} * {v[0]})"]
    dot = " + ".join(f"{a} * {b}" for a, b in zip(k, v, strict=True))
    return ", ".join(f"round({v[i]} * cos(a) + {cross[i]} * sin(a) + {k[i]} * ({dot}) * (1 - cos(a)), 6) AS {c}" for i, c in enumerate("xyz"))


@query("F7_quaternion_rotation", f"SELECT id, {_turn_sql()} FROM (SELECT id, lon, lat, id / 10e0 AS a FROM {{places}})")
def _(spark, sf):
    from cohortspark.plans.q_geo import places

    q = sc.rotation((1.0, 2.0, 2.0), F.col("id") / 10.0)
    turned = places(spark, sf).withColumn("q", q).select("id", sc.turned(F.col("q"), F.col("lon"), F.col("lat"), F.lit(1.0)).alias("v"))
    return turned.select("id", *(F.round(f"v.{c}", 6).alias(c) for c in "xyz"))


@query("F8_unit_conversion", f"SELECT c_custkey, c_acctbal * {1e3 / math.pow(1e3, 2)!r}::DOUBLE AS converted FROM customer")
def _(spark, sf):
    factor = sc.unit_factor("kg km^-2")
    return m.table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") * factor).alias("converted"))
