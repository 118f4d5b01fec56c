"""Queries of map algebra; undefined results are null."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cohortspark.functions.curves import polyline_sql
from cohortspark.operators import raster as r
from cohortspark.plans import model as m
from cohortspark.plans.q_joins import recursive_sql
from cohortspark.registry import CTES, cte, query

H, W = m.RASTER_H, m.RASTER_W
NULLED = "CASE WHEN isnan(v) THEN NULL ELSE round(v, 6) END AS v"


def shown(df):
    return df.select(*[c for c in df.columns if c != "v"], m.clean("v"))


COMBINE = {
    "plus": "a.v + b.v", "minus": "a.v - b.v", "times": "a.v * b.v", "div": "CASE WHEN b.v = 0 THEN 'nan'::DOUBLE ELSE a.v / b.v END",
    "invdiv": "CASE WHEN a.v = 0 THEN 'nan'::DOUBLE ELSE b.v / a.v END",
    "min": "CASE WHEN isnan(a.v) OR isnan(b.v) THEN 'nan'::DOUBLE ELSE least(a.v, b.v) END", "max": "CASE WHEN isnan(a.v) OR isnan(b.v) THEN 'nan'::DOUBLE ELSE greatest(a.v, b.v) END",
    "eq": "CASE WHEN NOT isnan(a.v) AND a.v = b.v THEN a.v ELSE 'nan'::DOUBLE END", "thr": "CASE WHEN NOT isnan(a.v) AND NOT isnan(b.v) AND a.v >= b.v THEN 1e0 ELSE 0e0 END",
    "set": "CASE WHEN isnan(b.v) THEN a.v ELSE b.v END", "isnan": "CASE WHEN isnan(a.v) THEN 1e0 ELSE 0e0 END", "setnan": "CASE WHEN isnan(a.v) THEN b.v ELSE a.v END",
    "log": "CASE WHEN NOT isnan(a.v) AND a.v > 0 THEN ln(a.v) ELSE 'nan'::DOUBLE END",
}


def _combine(op: str, sql: str) -> None:
    @query(f"R1_combine_{op}", f"SELECT y, x, {NULLED} FROM (SELECT a.y, a.x, {sql} AS v FROM {{raster_a}} a JOIN {{raster_b}} b ON a.y = b.y AND a.x = b.x)")
    def _(spark, sf):
        return shown(r.combine(op, m.raster(spark, sf, "a"), m.raster(spark, sf, "b")))


for _op, _sql in COMBINE.items():
    _combine(_op, _sql)


@query("R1_combine_scalar", f"SELECT y, x, {NULLED} FROM (SELECT y, x, CASE WHEN isnan(v) THEN v ELSE greatest(v * 2e0, 50e0) END AS v FROM {{raster_a}})")
def _(spark, sf):
    return shown(r.combine("max", r.combine("times", m.raster(spark, sf), 2.0), 50.0))


@query("R2_type_promotion", "SELECT y, x, CAST(a.v AS INTEGER) + b.v AS v FROM (SELECT * FROM {raster_a} WHERE NOT isnan(v) AND y = 3) a JOIN (SELECT * FROM {raster_b} WHERE NOT isnan(v)) b USING (y, x)".replace("CAST(a.v AS INTEGER)", "CAST(trunc(a.v) AS INTEGER)"))
def _(spark, sf):
    a = m.raster(spark, sf, "a").where(~F.isnan("v") & (F.col("y") == 3)).select("y", "x", F.col("v").cast("int").alias("v"))
    b = m.raster(spark, sf, "b").where(~F.isnan("v")).withColumnRenamed("v", "w")
    kind = r.promoted("int", "double")
    return a.join(b, ["y", "x"]).select("y", "x", (F.col("v").cast(kind) + F.col("w").cast(kind)).alias("v"))


@query("P10_masks", "SELECT y, x, CASE WHEN NOT isnan(v) AND v = 7 THEN 1e0 ELSE 0e0 END AS equal, CASE WHEN isnan(v) THEN 1e0 ELSE 0e0 END AS undefined, CASE WHEN isnan(v) THEN 1e0 ELSE 0e0 END AS not_numeric FROM {raster_b}")
def _(spark, sf):
    a = m.raster(spark, sf, "b")
    parts = [r.mask(a, "equal", 7.0).withColumnRenamed("v", "equal"), r.mask(a, "nan").withColumnRenamed("v", "undefined"), r.mask(a, "numeric", invert=True).withColumnRenamed("v", "not_numeric")]
    return parts[0].join(parts[1], ["y", "x"]).join(parts[2], ["y", "x"])


@query("G7_raster_stats", "SELECT round(sum(v) FILTER (WHERE NOT isnan(v)), 4) AS total, count(*) FILTER (WHERE NOT isnan(v)) AS n, round(avg(v) FILTER (WHERE NOT isnan(v)), 6) AS mean, min(v) FILTER (WHERE NOT isnan(v)) AS low, max(v) FILTER (WHERE NOT isnan(v)) AS high, count(*) FILTER (WHERE isnan(v)) AS n_nan, CAST(0 AS BIGINT) AS n_inf, count(*) AS n_all FROM {raster_a}")
def _(spark, sf):
    return r.statistics(m.raster(spark, sf)).withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@query("R4_extract", f"SELECT y - 2 AS y, x - 3 AS x, {NULLED} FROM {{raster_a}} WHERE y BETWEEN 2 AND 8 AND x BETWEEN 3 AND 6")
def _(spark, sf):
    return shown(r.extract(m.raster(spark, sf), 2, 9, 3, 7))


@query("R5_rescale", """SELECT CAST(g.y AS INTEGER) AS y, CAST(g.x AS INTEGER) AS x, CASE WHEN a.v IS NULL OR isnan(a.v) THEN NULL ELSE round(a.v, 6) END AS v
  FROM (SELECT i // 20 AS y, i % 20 AS x FROM range(360) t(i)) g LEFT JOIN {raster_a} a ON a.y = CAST(round(g.y * (12e0 / 18)) AS INTEGER) AND a.x = CAST(round(g.x * 0.5e0) AS INTEGER)""")
def _(spark, sf):
    return shown(r.rescale(m.raster(spark, sf), H, W, 18, 20))


def kernel_sql(kind: str, w: int, h: int) -> str:
    return ", ".join(f"({dy}, {dx}, {x!r}::DOUBLE)" for dy, dx, x in r.kernel(kind, w, h))


def convolve_sql(kind: str, w: int, h: int, centre: bool) -> str:
    value = "CASE WHEN isnan(a.v) THEN NULL ELSE round(mean, 6) END" if centre else "round(mean, 6)"
    return f"""SELECT a.y, a.x, {value} AS v FROM {{raster_a}} a LEFT JOIN (SELECT a.y, a.x, sum(b.v * w) / sum(w) AS mean FROM {{raster_a}} a, (VALUES {kernel_sql(kind, w, h)}) k(dy, dx, w), {{raster_a}} b
      WHERE b.y = a.y + dy AND b.x = a.x + dx AND NOT isnan(b.v) GROUP BY a.y, a.x) n ON n.y = a.y AND n.x = a.x"""


def _convolve(kind: str) -> None:
    @query(f"R6_convolve_{kind}", convolve_sql(kind, 5, 3, True))
    def _(spark, sf):
        return shown(r.convolve(m.raster(spark, sf), r.kernel(kind, 5, 3)))


for _kind in ("rect", "circ", "pyramid", "cone", "gauss"):
    _convolve(_kind)


@query("R7_convolve_nan", convolve_sql("gauss", 3, 3, False))
def _(spark, sf):
    return shown(r.convolve(m.raster(spark, sf), r.kernel("gauss", 3, 3), allow_nan=True))


@query("R8_majority", """SELECT a.y, a.x, CASE WHEN isnan(a.v) THEN NULL ELSE b.v END AS v FROM {classes} a LEFT JOIN (SELECT y, x, max({'n': n, 'v': v}) AS m, (max({'n': n, 'v': v})).v AS v FROM (
  SELECT a.y, a.x, b.v, count(*) AS n FROM {classes} a JOIN {classes} b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND NOT isnan(b.v) GROUP BY a.y, a.x, b.v) GROUP BY y, x) b ON a.y = b.y AND a.x = b.x""".replace("{classes}", "(SELECT y, x, CASE WHEN isnan(v) THEN v ELSE CAST(CAST(v AS BIGINT) % 4 AS DOUBLE) END AS v FROM {raster_b})"))
def _(spark, sf):
    return shown(r.majority(classes(spark, sf), 3, 3))


def classes(spark, sf):
    b = m.raster(spark, sf, "b")
    return b.select("y", "x", F.when(F.isnan("v"), F.col("v")).otherwise((F.col("v").cast("bigint") % 4).cast("double")).alias("v"))


@query("R9_fill_nan", """SELECT a.y, a.x, round(CASE WHEN isnan(a.v) THEN m.v ELSE a.v END, 6) AS v FROM {raster_a} a LEFT JOIN (SELECT a.y, a.x, avg(b.v) AS v FROM {raster_a} a JOIN {raster_a} b
  ON abs(a.y - b.y) + abs(a.x - b.x) = 1 AND NOT isnan(b.v) GROUP BY a.y, a.x) m ON m.y = a.y AND m.x = a.x""")
def _(spark, sf):
    return shown(r.fill_nan(m.raster(spark, sf)))


@query("R10_roll", f"SELECT (y + 29) % 12 AS y, (x + 3) % 10 AS x, {NULLED} FROM {{raster_a}}")
def _(spark, sf):
    return shown(r.roll(m.raster(spark, sf), 29, -17, H, W))


@query("R19_flip", f"SELECT 11 - y AS y, x, {NULLED} FROM {{raster_a}}")
def _(spark, sf):
    return shown(r.flip(m.raster(spark, sf), H))


@query("R11_translate", "SELECT y, x, CASE v WHEN 7 THEN 70e0 WHEN 12 THEN 1e0 ELSE -1e0 END AS v FROM {raster_b}")
def _(spark, sf):
    return r.translate(m.raster(spark, sf, "b"), [(7, 70), (12, 1)], -1)


@query("R12_generate", "SELECT CAST(i // 4 AS INTEGER) AS y, CAST(i % 4 AS INTEGER) AS x, 2.5e0 AS v FROM range(12) t(i)")
def _(spark, sf):
    return r.generate(spark, 3, 4, 2.5)


cte("probes", "SELECT CAST(c_custkey AS BIGINT) AS id, (c_custkey * 37 % 1050) / 100e0 AS py, (c_custkey * 53 % 850) / 100e0 AS px FROM customer")


def probes(spark, sf):
    i = F.col("c_custkey")
    return m.table(spark, sf, "customer").select(i.alias("id"), (i * 37 % 1050 / 100.0).alias("py"), (i * 53 % 850 / 100.0).alias("px"))


@query("R14_nearest", "SELECT id, CASE WHEN v IS NULL OR isnan(v) THEN NULL ELSE round(v, 6) END AS v FROM {probes} p LEFT JOIN {raster_a} a ON a.y = CAST(round(py) AS INTEGER) AND a.x = CAST(round(px) AS INTEGER)")
def _(spark, sf):
    return shown(r.sample(probes(spark, sf), m.raster(spark, sf)).select("id", "v"))


@query("R14_bilinear", """SELECT id, CASE WHEN isnan(v) THEN NULL ELSE round(v, 6) END AS v FROM (SELECT id, sum(CASE WHEN w > 0 THEN coalesce(a.v, 'nan'::DOUBLE) * w ELSE 0e0 END) AS v FROM (
  SELECT id, CAST(floor(py) AS INTEGER) + j AS y, CAST(floor(px) AS INTEGER) + i AS x, (CASE WHEN j = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE WHEN i = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS w
  FROM {probes}, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(j, i)) p LEFT JOIN {raster_a} a ON a.y = p.y AND a.x = p.x GROUP BY id)""")
def _(spark, sf):
    return shown(r.sample(probes(spark, sf), m.raster(spark, sf), "bilinear").select("id", "v"))


def _cubic(t: str) -> dict[int, str]:
    return {-1: f"((2 - {t}) * {t} - 1) * {t} / 2", 0: f"((3 * {t} - 5) * {t} * {t} + 2) / 2", 1: f"((4 - 3 * {t}) * {t} + 1) * {t} / 2", 2: f"({t} - 1) * {t} * {t} / 2"}


_TAPS = " UNION ALL ".join(
    f"SELECT id, CAST(floor(py) AS INTEGER) + {j} AS y, CAST(floor(px) AS INTEGER) + {i} AS x, ({wy}) * ({wx}) AS w FROM {{probes}}"
    for j, wy in _cubic("(py - floor(py))").items() for i, wx in _cubic("(px - floor(px))").items()
)


@query("R14_bicubic", f"""SELECT id, CASE WHEN isnan(v) THEN NULL ELSE round(v, 6) END AS v FROM (SELECT id, sum(CASE WHEN w <> 0 THEN coalesce(a.v, 'nan'::DOUBLE) * w ELSE 0e0 END) AS v
  FROM ({_TAPS}) p LEFT JOIN {{raster_a}} a ON a.y = p.y AND a.x = p.x GROUP BY id)""")
def _(spark, sf):
    return shown(r.sample(probes(spark, sf), m.raster(spark, sf), "bicubic").select("id", "v"))


_STEP_SQL = """SELECT p.y, p.x, (max({'v': q.v, 'y': q.y, 'x': q.x})).y AS ny, (max({'v': q.v, 'y': q.y, 'x': q.x})).x AS nx FROM {raster_b} p JOIN {raster_b} q
  ON (q.y - p.y + 12) % 12 IN (0, 1, 11) AND (q.x - p.x + 10) % 10 IN (0, 1, 9) AND NOT isnan(p.v) AND NOT isnan(q.v) AND q.v < p.v GROUP BY p.y, p.x"""
cte("descents", _STEP_SQL)


@query("R15_gradient_path", recursive_sql("""WITH RECURSIVE walk(n, y, x) AS (SELECT CAST(0 AS INTEGER), y, x FROM {raster_b} WHERE y = 5 AND x = 5 AND NOT isnan(v) UNION ALL SELECT w.n + 1, d.ny, d.nx FROM walk w JOIN {descents} d ON d.y = w.y AND d.x = w.x)
SELECT w.n, w.y, w.x, b.v FROM walk w JOIN {raster_b} b ON b.y = w.y AND b.x = w.x"""))
def _(spark, sf):
    return r.gradient_path(m.raster(spark, sf, "b"), 5, 5)


MIAMI = "least(3000e0 / (1 + exp(1.315e0 - 0.119e0 * t.v)), 3000e0 * (1 - exp(-0.000664e0 * (t.v * 30))))"


@query("R17_npp_map", f"""SELECT l.y, l.x, CASE WHEN l.v > 0 AND isnan(t.v) THEN NULL ELSE round(CASE WHEN l.v > 0 THEN cos(radians(-30e0 + l.y * 5e0 + 2.5e0)) * {MIAMI} ELSE 0e0 END, 6) END AS v
  FROM (SELECT y, x, CASE WHEN isnan(v) THEN 0e0 ELSE v END AS v FROM {{raster_b}}) l JOIN {{raster_a}} t ON t.y = l.y AND t.x = l.x""")
def _(spark, sf):
    a = m.raster(spark, sf, "a")
    land = r.combine("setnan", m.raster(spark, sf, "b"), 0.0)
    return shown(r.npp_map(land, a, r.combine("times", a, 30.0), -30.0, 5.0))


@query("R18_altitude_temperature", "SELECT t.y, t.x, CASE WHEN isnan(t.v) OR isnan(a.v) OR a.v * 40 < 300 THEN NULL ELSE round(t.v + a.v * 40 * -0.0065e0, 6) END AS v FROM {raster_a} t JOIN {raster_b} a ON a.y = t.y AND a.x = t.x")
def _(spark, sf):
    return shown(r.altitude_temperature(m.raster(spark, sf), r.combine("times", m.raster(spark, sf, "b"), 40.0), 300.0, -0.0065))


LEVELS = [(0.0, 0.0), (8000.0, -20.0), (20000.0, -125.0), (80000.0, -60.0)]


@query("R18a_sea_level", f"SELECT cell, round(altitude - ({polyline_sql('cell * 4000e0', LEVELS)}), 6) AS altitude FROM {{env}}")
def _(spark, sf):
    return m.env(spark, sf).select("cell", F.round(F.col("altitude") - r.sea_level(LEVELS, F.col("cell") * 4000.0), 6).alias("altitude"))


@query("R18b_island", "SELECT CAST(i // 9 AS INTEGER) AS y, CAST(i % 9 AS INTEGER) AS x, CASE WHEN i // 9 BETWEEN 2 AND 5 AND i % 9 BETWEEN 3 AND 6 THEN 1e0 ELSE 0e0 END AS v FROM range(72) t(i)")
def _(spark, sf):
    inside = F.col("y").between(2, 5) & F.col("x").between(3, 6)
    return r.generate(spark, 8, 9, 0.0).withColumn("v", inside.cast("double"))


cte("climate", "SELECT c_custkey AS id, CAST(c_custkey * 31 % 40 AS DOUBLE) AS temp, CAST(c_custkey * 173 % 3000 AS DOUBLE) AS rain, CAST(c_custkey % 6 + c_nationkey // 9 AS INTEGER) AS biome, CAST(c_custkey % 50 AS DOUBLE) AS v FROM customer")


def climate(spark, sf):
    i = F.col("c_custkey")
    return m.table(spark, sf, "customer").select(
        i.alias("id"), (i * 31 % 40).cast("double").alias("temp"), (i * 173 % 3000).cast("double").alias("rain"), (i % 6 + F.floor(F.col("c_nationkey") / 9)).cast("int").alias("biome"), (i % 50).cast("double").alias("v")
    )


cte("bins", "SELECT CAST(floor(temp / 4) AS BIGINT) AS tb, CAST(floor(rain / 150) AS BIGINT) AS rb, list_sort(list(DISTINCT biome)) AS biomes FROM {climate} GROUP BY 1, 2")


def bins(spark, sf):
    return r.biome_bins(climate(spark, sf), 4.0, 150.0)


@query("G10_biome_bins", "SELECT tb, rb, array_to_string(biomes, ',') AS biomes, len(biomes) > 1 AS multiple FROM {bins}")
def _(spark, sf):
    return bins(spark, sf).withColumn("biomes", F.array_join(F.transform("biomes", lambda b: b.cast("string")), ","))


cte("ring_votes", """SELECT m.tb, m.rb, greatest(abs(m.tb - s.tb), abs(m.rb - s.rb)) AS ring, s.biomes[1] AS biome, count(*) AS n
  FROM {bins} m JOIN {bins} s ON len(m.biomes) > 1 AND len(s.biomes) = 1 AND list_contains(m.biomes, s.biomes[1]) GROUP BY ALL""")
cte("ring_sums", "SELECT v.tb, v.rb, r.upto, v.biome, sum(v.n) AS n FROM {ring_votes} v JOIN (SELECT DISTINCT ring AS upto FROM {ring_votes}) r ON v.ring <= r.upto GROUP BY ALL")
cte("ring_leaders", "SELECT tb, rb, (min({'upto': upto, 'biome': biome})).biome AS biome FROM (SELECT *, count(*) FILTER (WHERE n = top) OVER (PARTITION BY tb, rb, upto) AS leaders FROM (SELECT *, max(n) OVER (PARTITION BY tb, rb, upto) AS top FROM {ring_sums})) WHERE n = top AND leaders = 1 GROUP BY tb, rb")


UNIQUE = "SELECT b.tb, b.rb, CASE WHEN len(b.biomes) = 1 THEN b.biomes[1] ELSE coalesce(v.biome, list_min(b.biomes)) END AS biome FROM {bins} b LEFT JOIN {ring_leaders} v ON v.tb = b.tb AND v.rb = b.rb"


@query("G11_biome_uniquify", UNIQUE)
def _(spark, sf):
    return r.uniquify(bins(spark, sf))


cte("far_bins", "SELECT tb * 9 AS tb, rb * 5 AS rb, CASE WHEN (tb + rb) % 4 = 0 THEN biomes[1:1] ELSE biomes END AS biomes FROM {bins}")


def _far(sql: str) -> str:
    for name in ("ring_votes", "ring_sums", "ring_leaders", "bins"):
        sql = sql.replace("{" + name + "}", "{far_" + name + "}")
    return sql


for _name in ("ring_votes", "ring_sums", "ring_leaders"):
    cte(f"far_{_name}", _far(CTES[_name]))


@query("G11_biome_uniquify_far", _far(UNIQUE))
def _(spark, sf):
    """The same bins thinly spread: what decides is many rings away."""
    b = bins(spark, sf)
    one = F.when((F.col("tb") + F.col("rb")) % 4 == 0, F.slice("biomes", 1, 1)).otherwise(F.col("biomes"))
    return r.uniquify(b.select((F.col("tb") * 9).alias("tb"), (F.col("rb") * 5).alias("rb"), one.alias("biomes")))


@query("R20_apply_biomes", "SELECT c.id, coalesce(list_min(b.biomes), -1) AS biome FROM {climate} c LEFT JOIN {bins} b ON b.tb = CAST(floor(c.temp / 4) AS BIGINT) AND b.rb = CAST(floor(c.rain / 150) AS BIGINT)")
def _(spark, sf):
    table = bins(spark, sf).select("tb", "rb", F.array_min("biomes").alias("b"))
    c = climate(spark, sf).withColumns({"tb": F.floor(F.col("temp") / 4.0), "rb": F.floor(F.col("rain") / 150.0)})
    return c.join(table, ["tb", "rb"], "left").select("id", F.coalesce("b", F.lit(-1)).alias("biome"))


cte("cap_bins", "SELECT CAST(floor(temp / 4) AS BIGINT) AS tb, CAST(floor(rain / 150) AS BIGINT) AS rb, avg(v) AS mean, stddev_pop(v) AS std, count(*) AS n FROM {climate} GROUP BY 1, 2")


@query("G12_capacity_bins", """SELECT w.tb, w.rb, round(coalesce(c.mean, n.near), 6) AS mean, round(c.std, 6) AS std FROM (SELECT CAST(i // 20 AS BIGINT) AS tb, CAST(i % 20 AS BIGINT) AS rb FROM range(200) t(i)) w LEFT JOIN {cap_bins} c ON c.tb = w.tb AND c.rb = w.rb
  LEFT JOIN (SELECT w.tb, w.rb, avg(c.mean) AS near FROM (SELECT i // 20 AS tb, i % 20 AS rb FROM range(200) t(i)) w JOIN {cap_bins} c ON abs(c.tb - w.tb) <= 2 AND abs(c.rb - w.rb) <= 2 GROUP BY 1, 2) n ON n.tb = w.tb AND n.rb = w.rb""")
def _(spark, sf):
    b = r.capacity_by_bin(climate(spark, sf), 4.0, 150.0)
    wanted = r.generate(spark, 10, 20, 0.0).select(F.col("y").cast("bigint").alias("tb"), F.col("x").cast("bigint").alias("rb"))
    out = r.fill_bins(b, wanted, 2).join(b.select("tb", "rb", "std"), ["tb", "rb"], "left")
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


_AREA = f"(sin(radians(-30e0 + (y + 1) * 5e0)) - sin(radians(-30e0 + y * 5e0))) * {math.radians(36.0) * 6371.3**2!r}::DOUBLE"
SHARES = [(0, "grazer", 0.5), (1, "grazer", 0.2), (1, "browser", 0.4), (2, "browser", 0.7), (3, "grazer", 0.1)]


@query("G13_biomass", f"""SELECT species, round(sum({_AREA} * share * 0.002e0), 2) AS mass FROM (SELECT y, x, CASE WHEN isnan(v) THEN v ELSE CAST(CAST(v AS BIGINT) % 4 AS DOUBLE) END AS v FROM {{raster_b}}) b
  JOIN (VALUES {', '.join(f"({b}, '{s}', {x}e0)" for b, s, x in SHARES)}) p(biome, species, share) ON NOT isnan(v) AND v = biome GROUP BY species""")
def _(spark, sf):
    shares = spark.createDataFrame(SHARES, "biome int, species string, share double")
    return r.biomass(classes(spark, sf), shares, 0.002, 6371.3, -30.0, 5.0, 36.0).withColumn("mass", F.round("mass", 2))


@query("R18c_biome_state", "SELECT temp, (min({'w': -w, 'biome': biome})).biome AS biome FROM (SELECT temp, biome, sum(v) AS w FROM {climate} GROUP BY temp, biome) GROUP BY temp")
def _(spark, sf):
    return r.weighted_class(climate(spark, sf).select("temp", "biome", F.col("v").alias("weight")), ["temp"])


@query("R3_mask_numeric", "SELECT count(*) FILTER (WHERE NOT isnan(v)) AS n FROM {raster_a}")
def _(spark, sf):
    return r.mask(m.raster(spark, sf), "numeric").agg(F.sum("v").cast("bigint").alias("n"))
