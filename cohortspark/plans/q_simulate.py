"""Queries of the step loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions.draws import u_sql
from cohortspark.plans import model as m
from cohortspark.plans import simulate as s
from cohortspark.registry import cte, query

cte("nbrs", "SELECT cell, list(nbr ORDER BY k) AS ns FROM {edges} GROUP BY cell")
cte("sim0", "SELECT id, cell, life_state, CAST(gender AS INTEGER) AS gender FROM {agents} WHERE life_state > 0")


def _step(n: int) -> None:
    d = lambda action, i="id": u_sql(7, n, action, i)
    b, dd = "(0.2e0 + (0.05e0 - 0.2e0) * n / 70e0)", "(0.02e0 + (0.05e0 - 0.02e0) * n / 70e0)"
    cte(f"acts{n}", f"""SELECT *, {d('birth')} < {b} AS is_birth, ({b} < 0 AND {d('birth')} < -{b}) OR {d('death')} < {dd} AS is_dead,
      CASE WHEN {d('move')} < 0.3e0 THEN ns[CAST(least(floor({d('where')} * 4), 3) AS INTEGER) + 1] END AS target
      FROM (SELECT a.*, count(*) OVER (PARTITION BY a.cell) AS n, ns FROM {{sim{n}}} a JOIN {{nbrs}} g ON g.cell = a.cell)""")
    cte(f"babies{n}", f"SELECT cell, ('0x' || substr(md5(concat_ws('|', 'child', id || '.1', '{n}')), 1, 13))::BIGINT + {1 << 40} AS child FROM {{acts{n}}} WHERE is_birth")
    cte(f"sim{n + 1}", f"""SELECT id, CAST(coalesce(target, cell) AS INTEGER) AS cell, CASE WHEN target IS NULL THEN life_state ELSE life_state & ~8 END AS life_state, gender FROM {{acts{n}}} WHERE NOT is_dead
      UNION ALL SELECT child, cell, CASE WHEN {d('gender', 'child')} < 0.5 THEN 5 ELSE 1 END, CASE WHEN {d('gender', 'child')} < 0.5 THEN 0 ELSE 1 END FROM {{babies{n}}}""")


for _n in range(3):
    _step(_n)


def three_steps(spark, sf):
    """Logistic growth, then random moves, for three steps."""
    agents = m.agents(spark, sf).where("life_state > 0").select("id", "cell", "life_state", "gender")
    sim = s.Simulation({"a": agents}, {}, m.edges(spark, sf), m.env(spark, sf), seed=7)
    sim.add_action("a", s.random_move(0.3, priority=2))
    sim.add_action("a", s.verhulst(0.2, 0.02, 0.05, 70.0, priority=1))
    sim.run(3)
    return sim.populations["a"]


@query("D27_three_steps", "SELECT id, cell, life_state, gender FROM {sim3}")
def _(spark, sf):
    return three_steps(spark, sf)


@query("D26_counts_after_three_steps", "SELECT cell, count(*) AS n, count(*) FILTER (WHERE gender = 0) AS females FROM {sim3} GROUP BY cell")
def _(spark, sf):
    return three_steps(spark, sf).groupBy("cell").agg(F.count("*").alias("n"), F.count_if(F.col("gender") == 0).alias("females"))


cte("hunted0_prey", "SELECT id, cell, life_state, CAST(gender AS INTEGER) AS gender, mass FROM {agents} WHERE life_state > 0")
cte("hunted0_pred", "SELECT id, cell, life_state, gender, mass FROM {predators} WHERE life_state > 0")


def _hunted(n: int) -> None:
    """The SQL of one step of hunters and prey."""
    d = lambda action, i="id": u_sql(7, n, action, i)
    b, dd = "(0.2e0 + (0.05e0 - 0.2e0) * n / 70e0)", "(0.01e0 + (0.05e0 - 0.01e0) * n / 70e0)"
    child = f"('0x' || substr(md5(concat_ws('|', 'child', id || '.1', '{n}')), 1, 13))::BIGINT + {1 << 40} AS child"
    born = f"CASE WHEN {d('gender', 'child')} < 0.5 THEN 5 ELSE 1 END, CASE WHEN {d('gender', 'child')} < 0.5 THEN 0 ELSE 1 END"
    cte(f"caught{n}", f"""SELECT p.id AS pred, y.id AS prey, y.mass * 0.3e0 AS gain FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY id) AS i FROM {{hunted{n}_pred}}) p
      JOIN (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {d('prey')}, id) AS i FROM {{hunted{n}_prey}}) y ON p.cell = y.cell AND p.i = y.i WHERE {d('hunt', 'p.id')} < 0.7e0""")
    cte(f"fed{n}", f"""SELECT *, least(m, 12e0) AS mc, m < 0.5e0 AS died, (0.8e0 + {d('baby')} * 0.4e0) * 4e0 AS baby
      FROM (SELECT p.*, p.mass + coalesce(gain, 0e0) + -0.2e0 AS m FROM {{hunted{n}_pred}} p LEFT JOIN {{caught{n}}} c ON c.pred = p.id)""")
    cte(f"hunted{n + 1}_pred", f"""SELECT id, cell, life_state, gender, CASE WHEN mc > baby THEN mc - baby ELSE mc END AS mass FROM {{fed{n}}} WHERE NOT died
      UNION ALL SELECT child, cell, {born}, baby FROM (SELECT *, {child} FROM {{fed{n}}} WHERE mc > baby AND NOT died)""")
    cte(f"grazed{n}", f"""SELECT *, NOT eaten AND {d('birth')} < {b} AS is_birth, eaten OR ({b} < 0 AND {d('birth')} < -{b}) OR {d('death')} < {dd} AS died,
      CASE WHEN {d('move')} < 0.2e0 THEN ns[CAST(least(floor({d('where')} * 4), 3) AS INTEGER) + 1] END AS target
      FROM (SELECT a.*, count(*) OVER (PARTITION BY a.cell) AS n, ns, c.prey IS NOT NULL AS eaten FROM {{hunted{n}_prey}} a JOIN {{nbrs}} g ON g.cell = a.cell LEFT JOIN {{caught{n}}} c ON c.prey = a.id)""")
    cte(f"hunted{n + 1}_prey", f"""SELECT id, CAST(coalesce(target, cell) AS INTEGER) AS cell, CASE WHEN target IS NULL THEN life_state ELSE life_state & ~8 END AS life_state, gender, mass FROM {{grazed{n}}} WHERE NOT died
      UNION ALL SELECT child, cell, {born}, NULL FROM (SELECT *, {child} FROM {{grazed{n}}} WHERE is_birth)""")


for _n in range(2):
    _hunted(_n)


@query("D27_two_species", "SELECT cell, count(*) AS n, 'prey' AS species FROM {hunted2_prey} GROUP BY cell UNION ALL SELECT cell, count(*), 'pred' FROM {hunted2_pred} GROUP BY cell")
def _(spark, sf):
    """Predators and prey for two steps: hunting, mass, births; rows per species and cell."""
    prey = m.agents(spark, sf).where("life_state > 0").select("id", "cell", "life_state", "gender", "mass")
    pred = m.predators(spark, sf).select("id", "cell", "life_state", "gender", "mass")
    sim = s.Simulation({"prey": prey, "pred": pred}, {}, m.edges(spark, sf), m.env(spark, sf))
    sim.add_action("pred", s.hunting("prey", 0.7, 0.3, priority=1))
    sim.add_action("pred", s.mass_manager(-0.2, 0.5, 12.0, priority=2))
    sim.add_action("pred", s.birther(4.0, 0.2, priority=3))
    sim.add_action("prey", s.verhulst(0.2, 0.01, 0.05, 70.0, priority=2))
    sim.add_action("prey", s.random_move(0.2, priority=3))
    sim.run(2)
    parts = [p.groupBy("cell").agg(F.count("*").alias("n")).withColumn("species", F.lit(n)) for n, p in sim.populations.items()]
    return parts[0].unionByName(parts[1])
