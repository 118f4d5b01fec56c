"""Queries over agents: states, rates, births, deaths, moves, arrivals."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cohortspark.functions.curves import great_circle, great_circle_sql
from cohortspark.functions.draws import u_sql
from cohortspark.operators import evaluators, moving, rates
from cohortspark.plans import model as m
from cohortspark.plans.q_cells import w_alt
from cohortspark.registry import cte, query

SEED, STEP = 7, 3
ALIVE = "life_state > 0"
cte("counts", "SELECT cell, count(*) AS n FROM {agents} WHERE life_state > 0 GROUP BY cell")
cte("counted", "SELECT a.*, coalesce(n, 0) AS n FROM {agents} a LEFT JOIN {counts} c ON a.cell = c.cell")


def draw(action: str, id_: str = "id") -> str:
    return u_sql(SEED, STEP, action, id_)


@query("P1_alive", "SELECT id, cell, life_state FROM {agents} WHERE life_state > 0")
def _(spark, sf):
    return rates.alive(m.agents(spark, sf)).select("id", "cell", "life_state")


@query("P2_gender", "SELECT CAST(gender AS INTEGER) AS gender, count(*) AS n, CAST(NULL AS BIGINT) AS n_all FROM {agents} WHERE gender = 1 GROUP BY gender UNION ALL SELECT NULL, NULL, count(*) FROM {agents}")
def _(spark, sf):
    a = m.agents(spark, sf)
    males = a.where("gender = 1").groupBy("gender").agg(F.count("*").alias("n")).withColumn("n_all", F.lit(None).cast("bigint"))
    return males.unionByName(a.agg(F.count("*").alias("n_all")).select(F.lit(None).cast("int").alias("gender"), F.lit(None).cast("bigint").alias("n"), "n_all"))


@query("P3_get_old", "SELECT id, CASE WHEN life_state > 0 THEN 20e0 - birth_time END AS age FROM {agents}")
def _(spark, sf):
    return rates.get_old(m.agents(spark, sf), 20.0).select("id", "age")


cte("aged", "SELECT *, CASE WHEN life_state > 0 THEN 5e0 - birth_time END AS age FROM {agents}")


@query("P4_fertility", """SELECT id, CASE WHEN life_state > 0 THEN CASE WHEN CASE WHEN gender = 0 THEN age > 15 AND age < 50 AND 5 - last_birth > 10 ELSE age > 15 END THEN 5 ELSE 1 END
  ELSE life_state END AS life_state FROM {aged}""")
def _(spark, sf):
    return rates.fertility(rates.get_old(m.agents(spark, sf), 5.0), 5.0, 15, 50, 10).select("id", "life_state")


@query("P5_old_age_death", f"SELECT id, coalesce(life_state > 0 AND age * (0.9e0 + {draw('oldage')} * 0.2e0) > 50, false) AS is_dead FROM {{aged}}")
def _(spark, sf):
    return rates.old_age_death(rates.get_old(m.agents(spark, sf), 5.0), 50.0, 0.1, SEED, STEP).select("id", "is_dead")


@query("P6_mass_manager", "SELECT id, mass - 0.7e0 < 1 AS is_dead, round(least(mass - 0.7e0, 7.5e0), 6) AS mass FROM {agents}")
def _(spark, sf):
    return rates.manage_mass(m.agents(spark, sf), -0.7, 1.0, 7.5).select("id", "is_dead", F.round("mass", 6).alias("mass"))


@query("G1_agents_per_cell", "SELECT cell, n FROM {counts}")
def _(spark, sf):
    return rates.counts(m.agents(spark, sf))


@query("G2_state_totals", "SELECT count(*) FILTER (WHERE life_state & 5 = 5) AS fertile, count(*) FILTER (WHERE life_state & 8 <> 0) AS moving, count(*) FILTER (WHERE life_state = 0) AS dead, count(*) AS total FROM {agents}")
def _(spark, sf):
    s = F.col("life_state")
    return m.agents(spark, sf).agg(
        F.count_if(s.bitwiseAND(5) == 5).alias("fertile"), F.count_if(s.bitwiseAND(8) != 0).alias("moving"), F.count_if(s == 0).alias("dead"), F.count("*").alias("total")
    )


B_SQL = "CASE WHEN {k} <= 0 THEN 0e0 ELSE {b0}e0 + ({th}e0 - {b0}e0) * n / {k} END"
K = 80.0
BIRTH = B_SQL.format(k="80e0", b0="0.2", th="0.05")
NEG = B_SQL.format(k="20e0", b0="0.2", th="0.02")
DEATH = "CASE WHEN 80e0 <= 0 THEN 1e0 ELSE 0.01e0 + (0.05e0 - 0.01e0) * n / 80e0 END"


@query("D1_linear_birth", f"SELECT id, life_state > 0 AND {draw('birth')} < {NEG} AS is_birth, life_state > 0 AND ({NEG}) < 0 AND {draw('birth')} < -({NEG}) AS is_dead FROM {{counted}}")
def _(spark, sf):
    """A small capacity, so that some rates are negative and kill."""
    a = rates.with_counts(m.agents(spark, sf))
    return rates.linear_birth(a, 0.2, 0.02, F.lit(20.0), SEED, STEP).select("id", "is_birth", "is_dead")


@query("D2_linear_death", f"SELECT id, life_state > 0 AND {draw('death')} < {DEATH} AS is_dead FROM {{counted}}")
def _(spark, sf):
    return rates.linear_death(rates.with_counts(m.agents(spark, sf)), 0.01, 0.05, F.lit(K), SEED, STEP).select("id", "is_dead")


cte("stepped", f"SELECT *, life_state > 0 AND {draw('birth')} < {BIRTH} AS is_birth, life_state > 0 AND (({BIRTH}) < 0 AND {draw('birth')} < -({BIRTH}) OR {draw('death')} < {DEATH}) AS is_dead FROM {{counted}}")


def stepped(spark, sf):
    return rates.verhulst(m.agents(spark, sf), 0.2, 0.01, 0.05, F.lit(K), SEED, STEP)


@query("D3_verhulst_step", "SELECT cell, count(*) FILTER (WHERE life_state > 0 AND NOT is_dead) + count(*) FILTER (WHERE is_birth) AS n FROM {stepped} GROUP BY cell")
def _(spark, sf):
    """The flagship: population per cell after one logistic growth step."""
    left = F.count_if((F.col("life_state") > 0) & ~F.col("is_dead")) + F.count_if("is_birth")
    return stepped(spark, sf).groupBy("cell").agg(left.alias("n"))


@query("D3_verhulst_crowd", f"""SELECT cell, count(*) - count(*) FILTER (WHERE d < 0.01e0 + 0.04e0 * n / 80e0) + count(*) FILTER (WHERE b < 0.2e0 + (0.05e0 - 0.2e0) * n / 80e0) AS n_next FROM (
  SELECT cell, {draw('death')} AS d, {draw('birth')} AS b, count(*) OVER (PARTITION BY cell) AS n FROM {{crowd}}) GROUP BY cell""")
def _(spark, sf):
    """The same step over the large set of agents, without negative rates' deaths."""
    s = rates.linear_birth(rates.with_counts(m.crowd(spark, sf)), 0.2, 0.05, F.lit(K), SEED, STEP).drop("is_dead")
    s = rates.linear_death(s, 0.01, 0.05, F.lit(K), SEED, STEP)
    return s.groupBy("cell").agg((F.count("*") - F.count_if("is_dead") + F.count_if("is_birth")).alias("n_next"))


@query("D4_verhulst_var_k", f"""SELECT c.id, life_state > 0 AND {draw('birth')} < CASE WHEN k <= 0 THEN 0e0 ELSE 0.2e0 + (0.05e0 - 0.2e0) * n / k END AS is_birth,
  life_state > 0 AND ((CASE WHEN k <= 0 THEN 0e0 ELSE 0.2e0 + (0.05e0 - 0.2e0) * n / k END) < 0 AND {draw('birth')} < -(CASE WHEN k <= 0 THEN 0e0 ELSE 0.2e0 + (0.05e0 - 0.2e0) * n / k END)
  OR {draw('death')} < CASE WHEN k <= 0 THEN 1e0 ELSE 0.01e0 + (0.05e0 - 0.01e0) * n / k END) AS is_dead
  FROM {{counted}} c JOIN (SELECT cell, capacity AS k FROM {{capacity}}) e ON e.cell = c.cell""")
def _(spark, sf):
    k = evaluators.capacity(m.env(spark, sf))
    a = rates.with_counts(m.agents(spark, sf)).join(k, "cell")
    born = rates.linear_birth(a, 0.2, 0.05, F.when(F.col("capacity") > 0, F.col("capacity")).otherwise(F.lit(0.0)), SEED, STEP)
    return rates.linear_death(born, 0.01, 0.05, F.col("capacity"), SEED, STEP).select("id", "is_birth", "is_dead")


@query("D5_lotka_volterra", f"""SELECT a.id, life_state > 0 AND {draw('lvb', 'a.id')} < 0.05e0 AS is_birth, life_state > 0 AND {draw('lvd', 'a.id')} < 0e0 + greatest(-(-2.0e0 * coalesce(n, 0) / 50e0), 0e0) AS is_dead
  FROM {{agents}} a LEFT JOIN (SELECT cell, count(*) AS n FROM {{predators}} WHERE life_state > 0 GROUP BY cell) p ON p.cell = a.cell""")
def _(spark, sf):
    others = rates.counts(m.predators(spark, sf))
    return rates.lotka_volterra(m.agents(spark, sf), others, 0.05, -2.0, 50.0, SEED, STEP).select("id", "is_birth", "is_dead")


BABY = f"(0.8e0 + {draw('baby')} * 0.4e0) * 4e0"


@query("D6_birther", f"SELECT id, life_state > 0 AND mass > {BABY} AS is_birth, round(CASE WHEN life_state > 0 AND mass > {BABY} THEN {BABY} ELSE 0e0 END, 6) AS baby_mass, round(CASE WHEN life_state > 0 AND mass > {BABY} THEN mass - {BABY} ELSE mass END, 6) AS mass FROM {{agents}}")
def _(spark, sf):
    out = rates.birther(m.agents(spark, sf), 4.0, 0.2, SEED, STEP)
    return out.select("id", "is_birth", F.round("baby_mass", 6).alias("baby_mass"), F.round("mass", 6).alias("mass"))


CHILD = f"('0x' || substr(md5(concat_ws('|', 'child', id, '{STEP}')), 1, 13))::BIGINT + {1 << 40}"
cte("next_agents", f"""SELECT id, cell, life_state, birth_time, gender FROM {{stepped}} WHERE life_state > 0 AND NOT is_dead
  UNION ALL SELECT {CHILD}, cell, CASE WHEN {draw('gender')} < 0.5e0 THEN 5 ELSE 1 END, {float(STEP)}e0, CASE WHEN {draw('gender')} < 0.5e0 THEN 0 ELSE 1 END FROM {{stepped}} WHERE is_birth""")


@query("D8_births_deaths", "SELECT id, cell, life_state, birth_time, CAST(gender AS INTEGER) AS gender FROM {next_agents}")
def _(spark, sf):
    return rates.apply_births_deaths(stepped(spark, sf), STEP, SEED)


@query("D7_registered_events", "SELECT cell, count(*) FILTER (WHERE is_birth) AS births, count(*) FILTER (WHERE is_dead) AS deaths FROM {stepped} GROUP BY cell")
def _(spark, sf):
    return stepped(spark, sf).groupBy("cell").agg(F.count_if("is_birth").alias("births"), F.count_if("is_dead").alias("deaths"))


@query("D10_newborn_ids", f"SELECT id, {CHILD} AS child FROM {{agents}}")
def _(spark, sf):
    return m.agents(spark, sf).select("id", rates.newborn_id(F.col("id"), STEP).alias("child"))


cte("rect_open", """SELECT cell, k, CASE k WHEN 0 THEN CASE WHEN x > 0 THEN cell - 1 ELSE -1 END WHEN 1 THEN CASE WHEN y > 0 THEN cell - 5 ELSE -1 END
  WHEN 2 THEN CASE WHEN x < 4 THEN cell + 1 ELSE -1 END ELSE CASE WHEN y < 4 THEN cell + 5 ELSE -1 END END AS nbr FROM {cells}, (VALUES (0), (1), (2), (3)) t(k)""")
cte("nbrs_open", "SELECT cell, list(nbr ORDER BY k) AS nbrs, list(nbr ORDER BY k) FILTER (WHERE nbr >= 0) AS there FROM {rect_open} GROUP BY cell")


def open_edges(spark, sf):
    from cohortspark.operators.grid import lattice_edges

    return lattice_edges(m.cells(spark, sf), m.SIDE, m.SIDE, periodic=False)


GOES = f"life_state > 0 AND {draw('move')} < 0.4e0"
WHERE4 = f"CAST(least(floor({draw('where')} * 4), 3) AS INTEGER) + 1"


@query("D11_random_move_reflecting", f"SELECT id, CAST(CASE WHEN {GOES} THEN there[CAST(least(floor({draw('where')} * len(there)), len(there) - 1) AS INTEGER) + 1] END AS INTEGER) AS target FROM {{agents}} a JOIN {{nbrs_open}} n ON a.cell = n.cell")
def _(spark, sf):
    return moving.random_move(m.agents(spark, sf), open_edges(spark, sf), 0.4, SEED, STEP).select("id", "target")


@query("D11_random_move_absorbing", f"""SELECT id, CAST(CASE WHEN {GOES} AND nbrs[{WHERE4}] >= 0 THEN nbrs[{WHERE4}] END AS INTEGER) AS target, {GOES} AND nbrs[{WHERE4}] < 0 AS is_dead
  FROM {{agents}} a JOIN {{nbrs_open}} n ON a.cell = n.cell""")
def _(spark, sf):
    return moving.random_move(m.agents(spark, sf), open_edges(spark, sf), 0.4, SEED, STEP, absorbing=True).select("id", "target", "is_dead")


@query("D12_random_move_1d", f"""SELECT id, CAST(CASE WHEN {GOES} THEN nullif(CASE WHEN {draw('where')} < 0.5e0 THEN nbrs[1] ELSE nbrs[3] END, -1) END AS INTEGER) AS target
  FROM {{agents}} a JOIN {{nbrs_open}} n ON a.cell = n.cell""")
def _(spark, sf):
    return moving.random_move_1d(m.agents(spark, sf), open_edges(spark, sf), 0.4, SEED, STEP).select("id", "target")


PI = repr(math.pi) + "::DOUBLE"
cte("angles", f"SELECT cell, k, nbr, CASE k WHEN 0 THEN {PI} WHEN 1 THEN -{PI} / 2 WHEN 2 THEN 0e0 ELSE {PI} / 2 END AS angle FROM {{edges}}")


@query("D13_dir_move", f"""SELECT id, CAST(CASE WHEN go THEN b.nbr END AS INTEGER) AS target, round(CASE WHEN go THEN error + b.angle - direction ELSE error END, 6) AS new_error FROM (
  SELECT id, direction, error, life_state > 0 AND age > 5 AS go, min({{'d': abs(CASE WHEN d > {PI} / 2 THEN d - 2 * {PI} WHEN d < -{PI} / 2 THEN d + 2 * {PI} ELSE d END), 'k': k, 'nbr': nbr, 'angle': angle}}) AS b FROM (
    SELECT a.id, a.life_state, a.age, g.*, (a.id % 63 - 31) / 10e0 AS direction, (a.id % 7) / 20e0 AS error, (a.id % 63 - 31) / 10e0 - (a.id % 7) / 20e0 - angle AS d
    FROM {{aged}} a JOIN {{angles}} g ON a.cell = g.cell) GROUP BY ALL)""")
def _(spark, sf):
    angle = F.when(F.col("k") == 0, math.pi).when(F.col("k") == 1, -math.pi / 2).when(F.col("k") == 2, 0.0).otherwise(math.pi / 2)
    a = rates.get_old(m.agents(spark, sf), 5.0).withColumns({"direction": (F.col("id") % 63 - 31) / 10.0, "error": F.col("id") % 7 / 20.0})
    out = moving.directed_move(a, m.edges(spark, sf).withColumn("angle", angle))
    return out.select("id", "target", F.round("new_error", 6).alias("new_error"))


cte("cum_lists", "SELECT cell, list(cum ORDER BY k) AS c, list(nbr ORDER BY k) AS n FROM {cum_alt} GROUP BY cell")
cte("move_tables", "SELECT a.id, a.cell, a.life_state, e.ice, c, n FROM {agents} a JOIN {cum_lists} l ON a.cell = l.cell JOIN {env} e ON e.cell = a.cell")
R5 = f"CAST(least(floor({draw('where')} * 5), 4) AS INTEGER) + 1"
_shut = "(c[2] = c[1])::INT + (c[3] = c[2])::INT + (c[4] = c[3])::INT + (c[5] = c[4])::INT"
cte("weighted_moves", f"""SELECT id, cell, life_state, CASE WHEN life_state > 0 AND NOT ice AND {draw('move')} < 0.6e0 AND {draw('shut')} > ({_shut}) / 4e0
    AND place > 1 THEN n[place] END AS target FROM (SELECT *, CASE WHEN c[5] > c[1] THEN
    len(list_filter(c, lambda x: x <= c[1] + {draw('where')} * (c[5] - c[1]))) + 1 ELSE {R5} END AS place FROM {{move_tables}})""")


def weighted(spark, sf):
    return moving.weighted_move(m.agents(spark, sf), w_alt(spark, sf), m.env(spark, sf), 0.6, SEED, STEP)


@query("D14_weighted_move", "SELECT id, CAST(target AS INTEGER) AS target FROM {weighted_moves}")
def _(spark, sf):
    return weighted(spark, sf).select("id", "target")


@query("D15_weighted_move_rand", f"""SELECT id, CAST(CASE WHEN life_state > 0 AND NOT ice AND {draw('move')} < 0.6e0 AND place > 1 THEN n[place] END AS INTEGER) AS target FROM (
  SELECT *, CASE WHEN c[5] > 0 THEN len(list_filter(c, lambda x: x <= {draw('where')} * c[5])) + 1 ELSE {R5} END AS place FROM {{move_tables}})""")
def _(spark, sf):
    return moving.weighted_move(m.agents(spark, sf), w_alt(spark, sf), m.env(spark, sf), 0.6, SEED, STEP, uniform_if_zero=True).select("id", "target")


@query("D16_cond_weighted_move", "SELECT w.id, CAST(CASE WHEN t.npp * 0.9e0 >= h.npp THEN w.target END AS INTEGER) AS target FROM {weighted_moves} w LEFT JOIN {env} h ON h.cell = w.cell LEFT JOIN {env} t ON t.cell = w.target")
def _(spark, sf):
    return moving.allow_if(weighted(spark, sf), m.env(spark, sf), "npp", 0.9).select("id", "target")


@query("P9_simple_condition", "SELECT h.cell, CAST(nbr AS INTEGER) AS nbr, t.npp * 0.2e0 >= h.npp AS allowed FROM {edges} g JOIN {env} h ON h.cell = g.cell JOIN {env} t ON t.cell = g.nbr")
def _(spark, sf):
    pairs = m.edges(spark, sf).select("cell", "nbr", F.col("nbr").alias("target"))
    out = moving.allow_if(pairs, m.env(spark, sf), "npp", 0.2)
    return out.select("cell", "nbr", F.col("target").isNotNull().alias("allowed"))


@query("P8_confined_move", "SELECT id, CAST(CASE WHEN target % 2 = 0 THEN target END AS INTEGER) AS target FROM {weighted_moves}")
def _(spark, sf):
    return moving.confine(weighted(spark, sf), m.cells(spark, sf).where("cell % 2 = 0")).select("id", "target")


@query("D9_apply_moves", "SELECT id, CAST(coalesce(target, cell) AS INTEGER) AS cell, CASE WHEN target IS NOT NULL THEN life_state & ~8 ELSE life_state END AS life_state FROM {weighted_moves}")
def _(spark, sf):
    return moving.apply_moves(weighted(spark, sf)).select("id", "cell", "life_state")


GC = great_circle_sql("a.lon", "a.lat", "b.lon", "b.lat")
cte("nav_edges", f"SELECT a.cell AS port, b.cell AS dest, {GC} AS dist FROM {{cells}} a JOIN {{cells}} b ON a.cell <> b.cell AND a.cell % 3 = 0 AND b.cell % 3 = 0 AND {GC} < 3000")


def nav_edges(spark, sf):
    c = m.cells(spark, sf).where("cell % 3 = 0")
    a, b = (c.select(*(F.col(x).alias(p + x) for x in ("cell", "lon", "lat"))) for p in "ab")
    d = great_circle(F.col("alon"), F.col("alat"), F.col("blon"), F.col("blat"))
    return a.join(b, (F.col("acell") != F.col("bcell")) & (d < 3000)).select(F.col("acell").alias("port"), F.col("bcell").alias("dest"), d.alias("dist"))


_A = 0.3 / math.exp(-0.0006 * 1000)
cte("nav_probs", f"SELECT *, sum(p) OVER (PARTITION BY port ORDER BY dest ROWS UNBOUNDED PRECEDING) AS upto, sum(p) OVER (PARTITION BY port) AS total FROM (SELECT port, dest, {_A!r}::DOUBLE * exp(-0.0006e0 * dist) AS p FROM {{nav_edges}})")


@query("D17_navigate", f"""SELECT a.id, CAST(CASE WHEN life_state > 0 AND life_state & 8 = 0 AND NOT ice THEN (SELECT min(dest) FROM {{nav_probs}} p WHERE p.port = a.cell AND total < 1 AND {draw('ship', 'a.id')} < upto) END AS INTEGER) AS target
  FROM {{agents}} a JOIN {{env}} e ON e.cell = a.cell""")
def _(spark, sf):
    table = moving.navigation_table(nav_edges(spark, sf), 0.3, 1000.0, -0.0006)
    return moving.navigate(m.agents(spark, sf), table, m.env(spark, sf), SEED, STEP).select("id", "target")


@query("D17_port_probabilities", "SELECT port, dest, round(p, 6) AS p FROM {nav_probs} WHERE total < 1")
def _(spark, sf):
    return moving.navigation_table(nav_edges(spark, sf), 0.3, 1000.0, -0.0006).withColumn("p", F.round("p", 6))


cte("visited", "SELECT cell, CAST(cell AS INTEGER) AS hops, CAST(cell * 100 AS DOUBLE) AS dist, 1e0 AS time FROM {cells} WHERE cell < 6")


@query("G3_first_arrivals", f"""SELECT cell, hops, dist, time FROM {{visited}} UNION ALL
  SELECT target, b.hops, round(b.dist, 6), 9e0 FROM (SELECT m.target, min({{'dist': v.dist + {GC}, 'hops': v.hops + 1}}) AS b
  FROM (SELECT DISTINCT source, target FROM {{moves}}) m JOIN {{visited}} v ON v.cell = m.source JOIN {{cells}} a ON a.cell = m.source JOIN {{cells}} b ON b.cell = m.target
  WHERE m.target NOT IN (SELECT cell FROM {{visited}}) GROUP BY m.target)""")
def _(spark, sf):
    c = m.cells(spark, sf)
    visited = c.where("cell < 6").select("cell", F.col("cell").cast("int").alias("hops"), (F.col("cell") * 100).cast("double").alias("dist"), F.lit(1.0).alias("time"))
    a, b = (c.select(F.col("cell").alias(n), F.col("lon").alias(p + "lon"), F.col("lat").alias(p + "lat")) for n, p in (("source", "a"), ("target", "b")))
    routes = m.moves(spark, sf).select("source", "target").distinct()
    dist = routes.join(a, "source").join(b, "target").select("source", "target", great_circle(F.col("alon"), F.col("alat"), F.col("blon"), F.col("blat")).alias("d"))
    return moving.first_arrivals(routes, visited, dist, 9).withColumn("dist", F.round("dist", 6))
