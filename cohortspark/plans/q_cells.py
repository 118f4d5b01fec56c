"""Queries over cells: filters, evaluators, capacity, climate, lattices, curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions.curves import NPP_MIAMI_SQL, npp_miami, polyline, polyline_sql
from cohortspark.functions.draws import u, u_sql
from cohortspark.operators import evaluators, grid
from cohortspark.plans import model as m
from cohortspark.registry import cte, query

ALT = [(-400.0, 0.0), (-100.0, 0.5), (0.0, 1.0), (150.0, 0.25), (300.0, 0.0)]
NPP = [(100.0, 0.0), (800.0, 1.0), (1800.0, 0.4)]

cte("sided", "SELECT cell, k, nbr FROM {edges} UNION ALL SELECT cell, -1 AS k, cell AS nbr FROM {cells}")
cte("w_alt", f"SELECT s.cell, s.k, s.nbr, coalesce(CASE WHEN ice THEN 0.0e0 ELSE greatest({polyline_sql('altitude', ALT)}, 0.0e0) END, 0.0e0) AS value FROM {{sided}} s LEFT JOIN {{env}} e ON e.cell = s.nbr")
cte("w_npp", f"SELECT s.cell, s.k, s.nbr, coalesce(CASE WHEN ice THEN 0.0e0 ELSE greatest({polyline_sql('npp', NPP)}, 0.0e0) END, 0.0e0) AS value FROM {{sided}} s LEFT JOIN {{env}} e ON e.cell = s.nbr")
CUM = "sum(greatest(value, 0.0e0)) OVER (PARTITION BY cell ORDER BY k ROWS UNBOUNDED PRECEDING)"
cte("cum_alt", f"SELECT cell, k, nbr, value, {CUM} AS cum FROM {{w_alt}}")


def w_alt(spark, sf, cumulate=True):
    return evaluators.single_evaluator(m.edges(spark, sf), m.env(spark, sf), "altitude", ALT, cumulate)


def w_npp(spark, sf):
    return evaluators.single_evaluator(m.edges(spark, sf), m.env(spark, sf), "npp", NPP, False)


@query("Q9_rect_lattice", "SELECT cell, k, CAST(nbr AS INTEGER) AS nbr FROM {edges}")
def _(spark, sf):
    return m.edges(spark, sf)


def _hex_sql() -> str:
    def rows(steps):
        return " ".join(f"WHEN {k} THEN (y + {dy}) * 5 + x + {dx}" for k, (dx, dy) in enumerate(steps))

    def ok(steps):
        return " ".join(f"WHEN {k} THEN x + {dx} BETWEEN 0 AND 4 AND y + {dy} BETWEEN 0 AND 4" for k, (dx, dy) in enumerate(steps))

    e, o = grid.HEX_EVEN, grid.HEX_ODD
    return f"""SELECT cell, CAST(k AS INTEGER) AS k, CAST(CASE WHEN y % 2 = 0 THEN CASE WHEN CASE k {ok(e)} END THEN CASE k {rows(e)} END ELSE -1 END
      ELSE CASE WHEN CASE k {ok(o)} END THEN CASE k {rows(o)} END ELSE -1 END END AS INTEGER) AS nbr FROM {{cells}}, (VALUES (0), (1), (2), (3), (4), (5)) t(k)"""


@query("Q9_hex_lattice", _hex_sql())
def _(spark, sf):
    return grid.lattice_edges(m.cells(spark, sf), m.SIDE, m.SIDE, periodic=False, hexagonal=True)


@query("Q10_polyline", f"SELECT cell, round({polyline_sql('altitude', ALT)}, 6) AS v, round(altitude, 6) AS same FROM {{env}}")
def _(spark, sf):
    return m.env(spark, sf).select("cell", F.round(polyline(F.col("altitude"), ALT), 6).alias("v"), F.round(polyline(F.col("altitude"), []), 6).alias("same"))


@query("J1_agent_env", "SELECT id, a.cell, round(altitude, 6) AS altitude, ice FROM {agents} a JOIN {env} e ON a.cell = e.cell WHERE life_state > 0")
def _(spark, sf):
    alive = m.agents(spark, sf).where("life_state > 0")
    return alive.join(m.env(spark, sf), "cell").select("id", "cell", F.round("altitude", 6).alias("altitude"), "ice")


@query("J2_neighbour_values", "SELECT s.cell, s.k, CAST(s.nbr AS INTEGER) AS nbr, round(coalesce(npp, 0.0e0), 6) AS value FROM {sided} s LEFT JOIN {env} e ON e.cell = s.nbr")
def _(spark, sf):
    return grid.with_neighbour_values(m.edges(spark, sf), m.env(spark, sf), "npp").withColumn("value", F.round("value", 6))


@query("D18_single_evaluator", "SELECT cell, k, CAST(nbr AS INTEGER) AS nbr, round(value, 6) AS value, round(cum, 6) AS cum FROM {cum_alt}")
def _(spark, sf):
    return w_alt(spark, sf).withColumns({"value": F.round("value", 6), "cum": F.round("cum", 6)})


@query("W1_prefix_weights", "SELECT cell, k, round(cum, 6) AS cum FROM {cum_alt}")
def _(spark, sf):
    return w_alt(spark, sf).select("cell", "k", F.round("cum", 6).alias("cum"))


def _multi_sql(total: str, cum: bool, block: bool = False) -> str:
    value = f"CASE WHEN least(a.value, n.value) <= 0 THEN 0.0e0 ELSE {total} END" if block else total
    body = f"SELECT a.cell, a.k, a.nbr, {value} AS value FROM {{w_alt}} a JOIN {{w_npp}} n ON a.cell = n.cell AND a.k = n.k"
    return f"SELECT cell, k, CAST(nbr AS INTEGER) AS nbr, round(value, 6) AS value{', round(' + CUM + ', 6) AS cum' if cum else ''} FROM ({body})"


def _multi(mode: str, total: str):
    simple, block = mode.endswith("simple"), mode.endswith("block")

    @query(f"D19_multi_{mode}", _multi_sql(total, not simple, block))
    def _(spark, sf):
        out = evaluators.multi_evaluator([(w_alt(spark, sf, False), 0.7), (w_npp(spark, sf), 1.5)], mode)
        return out.withColumns({c: F.round(c, 6) for c in ("value", "cum") if c in out.columns})


_A, _N = "a.value * 0.7e0", "n.value * 1.5e0"
for _mode, _total in {
    "add": f"{_A} + {_N}", "add_block": f"{_A} + {_N}", "add_simple": f"{_A} + {_N}", "mul": f"({_A}) * ({_N})",
    "max": f"greatest({_A}, {_N})", "max_block": f"greatest({_A}, {_N})", "max_simple": f"greatest({_A}, {_N})", "min": f"least({_A}, {_N})",
}.items():
    _multi(_mode, _total)


@query("D20_share_evaluator", f"""SELECT s.cell, s.k, round(coalesce(greatest({polyline_sql('n', [(0.0, 0.0), (50.0, 1.0)])}, 0.0e0), 0.0e0), 6) AS value FROM {{sided}} s
  LEFT JOIN (SELECT cell, CAST(count(*) AS DOUBLE) AS n FROM {{agents}} WHERE life_state > 0 GROUP BY cell) c ON c.cell = s.nbr""")
def _(spark, sf):
    """An evaluator over an array shared by another population: here the numbers of prey, as a view."""
    shared = m.agents(spark, sf).where("life_state > 0").groupBy("cell").agg(F.count("*").cast("double").alias("n")).withColumn("ice", F.lit(False))
    return evaluators.single_evaluator(m.edges(spark, sf), shared, "n", [(0.0, 0.0), (50.0, 1.0)], False).select("cell", "k", F.round("value", 6).alias("value"))


CAPACITY_SQL = f"""SELECT cell, CASE WHEN altitude >= 0 AND NOT ice THEN least((CASE WHEN eff <= 100 THEN 0.0e0 WHEN eff >= 1400 THEN 60.0e0
    ELSE 5.0e0 + 55.0e0 * (eff - 100.0e0) / 1300.0e0 END) * (CASE WHEN coastal THEN 1.3e0 ELSE 1.0e0 END * (1 + water * 0.5e0)), 60.0e0) ELSE 0.0e0 END AS capacity
  FROM (SELECT *, (CASE WHEN npp > 0 THEN npp ELSE {NPP_MIAMI_SQL} END) * CASE WHEN altitude >= 2500 THEN 0.0e0 WHEN altitude > 1500 THEN (2500.0e0 - altitude) / 1000 ELSE 1.0e0 END AS eff FROM {{env}})"""
cte("capacity", CAPACITY_SQL)


@query("D21_npp_capacity", "SELECT cell, round(capacity, 6) AS capacity FROM {capacity}")
def _(spark, sf):
    return evaluators.capacity(m.env(spark, sf)).withColumn("capacity", F.round("capacity", 6))


@query("D22_npp_miami", f"SELECT cell, round({NPP_MIAMI_SQL}, 6) AS npp FROM {{env}}")
def _(spark, sf):
    return m.env(spark, sf).select("cell", F.round(npp_miami(F.col("temp"), F.col("rain")), 6).alias("npp"))


@query("G15_max_npp", f"SELECT round(max({NPP_MIAMI_SQL}), 6) AS max_npp FROM {{env}}")
def _(spark, sf):
    return m.env(spark, sf).agg(F.round(F.max(npp_miami(F.col("temp"), F.col("rain"))), 6).alias("max_npp"))


@query("D23_npp_cover", "SELECT cell, round(npp * 0.611427e0 + rain * 0.362280e0 + (water * 100) * 2.456798e0, 6) AS npp FROM {env}")
def _(spark, sf):
    return m.env(spark, sf).select("cell", F.round(evaluators.npp_by_cover(F.col("npp"), F.col("rain"), F.col("water") * 100), 6).alias("npp"))


@query("D24_season_climate", "SELECT cell, round(temp + 4.5e0, 6) AS act_temp, round(rain * 0.4e0, 6) AS act_rain FROM {env}")
def _(spark, sf):
    out = evaluators.season_climate(m.env(spark, sf), [-6.0, 1.0, 4.5, 0.5], [0.1, 0.3, 0.4, 0.2], 2)
    return out.select("cell", F.round("act_temp", 6).alias("act_temp"), F.round("act_rain", 6).alias("act_rain"))


@query("P7_env_kill", "SELECT id, a.cell, CASE WHEN altitude < 0 OR ice THEN 0 ELSE life_state END AS life_state FROM {agents} a JOIN {env} e ON a.cell = e.cell")
def _(spark, sf):
    dead = (F.col("altitude") < 0) | F.col("ice")
    return m.agents(spark, sf).join(m.env(spark, sf), "cell").select("id", "cell", F.when(dead, 0).otherwise(F.col("life_state")).alias("life_state"))


@query("P11_bounding_boxes", "SELECT cell FROM {cells} WHERE (lon > -15 AND lon < 5 AND lat > -25 AND lat < 5) OR (lon > 9 AND lon < 30 AND lat > 5 AND lat < 30)")
def _(spark, sf):
    boxes = [(-15, 5, -25, 5), (9, 30, 5, 30)]
    inside = F.lit(False)
    for lo, hi, bottom, top in boxes:
        inside = inside | ((F.col("lon") > lo) & (F.col("lon") < hi) & (F.col("lat") > bottom) & (F.col("lat") < top))
    return m.cells(spark, sf).where(inside).select("cell")


cte("coast", """SELECT e.cell FROM {env} e JOIN {edges} g ON g.cell = e.cell JOIN {env} o ON o.cell = g.nbr
  JOIN {cells} c ON c.cell = e.cell WHERE e.altitude > 0 AND c.lon > -25 AND c.lon < 25 GROUP BY e.cell HAVING bool_or(o.altitude < 0)""")


def coast(spark, sf):
    """Cells above the sea, in the box, with any neighbour below it."""
    e = m.env(spark, sf).select("cell", "altitude")
    land = e.where("altitude > 0").join(m.cells(spark, sf).where("lon > -25 and lon < 25").select("cell"), "cell", "left_semi")
    sea = e.where("altitude < 0").select(F.col("cell").alias("nbr"))
    return m.edges(spark, sf).join(land, "cell", "left_semi").join(sea, "nbr", "left_semi").select("cell").distinct()


@query("P12_coastal_cells", "SELECT cell FROM {coast}")
def _(spark, sf):
    return coast(spark, sf)


DRAW = u_sql(7, 3, "draw", "id")


@query("W2_cumulative_draw", f"""SELECT id, cell, coalesce(min(CASE WHEN r * total < cum THEN k END), -1) AS k FROM (
  SELECT a.id, a.cell, {DRAW} AS r, c.k, c.cum, max(c.cum) OVER (PARTITION BY a.id) AS total FROM {{agents}} a JOIN {{cum_alt}} c ON a.cell = c.cell) GROUP BY id, cell""")
def _(spark, sf):
    draws = m.agents(spark, sf).select("id", "cell", u(7, 3, "draw", F.col("id")).alias("r"))
    return grid.draw_from(w_alt(spark, sf), draws).select("id", "cell", "k")
