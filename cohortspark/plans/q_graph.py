"""Queries of ancestry graphs, components and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import ancestry as an
from cohortspark.operators import regions
from cohortspark.plans import model as m
from cohortspark.plans.q_joins import recursive_sql
from cohortspark.registry import cte, query

cte("parents", "SELECT id AS child, mom AS parent FROM {ancestors} WHERE mom > 0 UNION ALL SELECT id, dad FROM {ancestors} WHERE dad > 0")
BACK = "WITH RECURSIVE back(origin, id, depth) AS (SELECT id, id, 0 FROM {ancestors} WHERE id IN (611, 624, 655, 702) UNION SELECT b.origin, p.parent, b.depth + 1 FROM back b JOIN {parents} p ON p.child = b.id)\n"


def samples(spark, sf):
    return m.ancestors(spark, sf).where("id in (611, 624, 655, 702)").select("id")


@query("N1_parents", "SELECT id, mom, dad FROM {ancestors} WHERE id % 50 = 0")
def _(spark, sf):
    return an.parents_of(m.ancestors(spark, sf), m.ancestors(spark, sf).where("id % 50 = 0").select("id"))


@query("N2_coalescence", recursive_sql(BACK + """SELECT s.a, s.b, t.time FROM (SELECT x.id AS a, y.id AS b FROM (SELECT DISTINCT origin AS id FROM back) x JOIN (SELECT DISTINCT origin AS id FROM back) y ON x.id < y.id) s LEFT JOIN (
  SELECT x.origin AS a, y.origin AS b, max(n.time) AS time FROM (SELECT DISTINCT origin, id FROM back) x JOIN (SELECT DISTINCT origin, id FROM back) y ON x.id = y.id AND x.origin < y.origin JOIN {ancestors} n ON n.id = x.id GROUP BY 1, 2) t ON t.a = s.a AND t.b = s.b"""))
def _(spark, sf):
    return an.coalescence(m.ancestors(spark, sf), samples(spark, sf))


@query("N3_decode", "SELECT id, CAST(time AS BIGINT) AS time, CAST(cell AS BIGINT) AS cell FROM {ancestors}")
def _(spark, sf):
    packed = m.ancestors(spark, sf).select("id", (F.col("time").cast("bigint") * F.lit(1 << 32) + F.col("cell")).alias("p"))
    time, cell = an.decode(F.col("p"))
    return packed.select("id", time.alias("time"), cell.alias("cell"))


@query("N4_back_reach", recursive_sql(BACK + "SELECT origin, id, min(depth) AS depth FROM back GROUP BY origin, id"))
def _(spark, sf):
    return an.back_reach(m.ancestors(spark, sf), samples(spark, sf).select(F.col("id").alias("origin"), "id"))


@query("N6_evolve_graph")
def _(spark, sf):
    """The whole graph, in a logarithm of its generations' number of rounds."""
    a = m.ancestors(spark, sf)
    founders = a.where("mom = 0").join(m.genomes(spark, sf), "id").select("id", "strand1", "strand2")
    return an.evolve(a, founders, 3, 11)


ROUND = "SELECT * FROM {%s} a WHERE id %% 9 = 0 OR id IN (SELECT mom FROM {%s} WHERE mom > 0 UNION SELECT dad FROM {%s} WHERE dad > 0)"


cte("pruned1", ROUND % (("ancestors",) * 3))
cte("pruned2", ROUND % (("pruned1",) * 3))


@query("N7_prune_childless", "SELECT id, mom, dad FROM {pruned2}")
def _(spark, sf):
    a = m.ancestors(spark, sf)
    return an.prune_childless(a, a.where("id % 9 = 0").select("id"), 2).select("id", "mom", "dad")


@query("N7a_lines_of_survivors", recursive_sql(BACK + "SELECT id, mom = 0 AS progenitor FROM {ancestors} WHERE id IN (SELECT id FROM back)"))
def _(spark, sf):
    return an.lines_of(m.ancestors(spark, sf), samples(spark, sf)).select("id", "progenitor")


@query("N7b_merge_graphs", "SELECT parent AS id, count(DISTINCT child) AS n_children, min(child) AS first_child FROM {parents} GROUP BY parent")
def _(spark, sf):
    a = m.ancestors(spark, sf)
    merged = an.merge_graphs(a.where("id % 3 = 0"), a.where("id % 3 <> 0"))
    return merged.select("id", F.size("children").cast("bigint").alias("n_children"), F.array_min("children").alias("first_child"))


@query("N8_analyse", "SELECT CAST(floor((id - 1) / 64) AS BIGINT) AS block, min(CASE WHEN mom > 0 THEN least(mom, dad) END) AS least_parent, max(id) AS \"limit\" FROM {ancestors} GROUP BY 1")
def _(spark, sf):
    return an.analyse(m.ancestors(spark, sf), 64)


LAND = "WITH RECURSIVE reach(a, b) AS (SELECT cell, cell FROM {env} WHERE altitude > 0 UNION SELECT r.a, p.b FROM reach r JOIN {land_pairs} p ON p.a = r.b)\n"


def land(spark, sf):
    return regions.cell_components(m.edges(spark, sf), m.env(spark, sf).where("altitude > 0").select("cell"))


@query("X1_components", recursive_sql(LAND + "SELECT a AS cell, min(b) AS component FROM reach GROUP BY a"))
def _(spark, sf):
    return land(spark, sf)


cte("by_third", "SELECT cell, cell % 3 AS component FROM {cells}")


@query("X2_sub_components", "SELECT a.component, b.component AS target, count(DISTINCT a.cell) AS n_cells FROM {edges} g JOIN {by_third} a ON a.cell = g.cell JOIN {by_third} b ON b.cell = g.nbr WHERE a.component <> b.component GROUP BY 1, 2")
def _(spark, sf):
    c = m.cells(spark, sf).select("cell", (F.col("cell") % 3).alias("component"))
    return regions.sub_components(m.edges(spark, sf), c)


_TAKES = {
    "smallest": "[(list_min(list_transform(list_filter(sizes, lambda x: list_contains(near, x.r)), lambda x: {'s': x.s, 'r': x.r}))).r]",
    "largest": "[-(list_max(list_transform(list_filter(sizes, lambda x: list_contains(near, x.r)), lambda x: {'s': x.s, 'r': -x.r}))).r]",
    "random": "[near[CAST(floor(('0x' || substr(md5(concat_ws('|', '1', step + 1, 'near')), 1, 8))::BIGINT / 4294967296.0 * len(near)) AS INTEGER) + 1]]",
    "all": "near",
}
cte("grown_cells", """SELECT list(c.cell ORDER BY c.cell) AS cells, list(c.ns ORDER BY c.cell) AS adj, list(coalesce(a.n, 0) ORDER BY c.cell) AS ws
  FROM (SELECT cell, list(DISTINCT CAST(nbr AS INTEGER)) AS ns FROM {edges} WHERE nbr >= 0 GROUP BY cell) c LEFT JOIN (SELECT cell, count(*) AS n FROM {agents} WHERE life_state > 0 GROUP BY cell) a ON a.cell = c.cell""")


def regions_sql(mode: str, n_regions: int) -> str:
    """One row a step: the region of every cell (numbered from 0) as a list."""
    return recursive_sql(f"""WITH RECURSIVE walk(step, reg) AS (SELECT 0, cells FROM {{grown_cells}} UNION ALL
  SELECT step + 1, list_transform(reg, lambda x: CASE WHEN list_contains({_TAKES[mode]}, x) THEN r ELSE x END) FROM (
    SELECT *, list_sort(list_filter(list_distinct(flatten(list_transform(list_filter(range(1, len(reg) + 1), lambda i: reg[i] = r), lambda i: list_transform(adj[i], lambda c: reg[c + 1])))), lambda x: x <> r)) AS near FROM (
      SELECT *, ties[CAST(floor(('0x' || substr(md5(concat_ws('|', '1', step + 1, 'tie')), 1, 8))::BIGINT / 4294967296.0 * len(ties)) AS INTEGER) + 1] AS r FROM (
        SELECT *, list_sort(list_transform(list_filter(sizes, lambda x: x.s = list_min(list_transform(sizes, lambda y: y.s))), lambda x: x.r)) AS ties FROM (
          SELECT w.step, w.reg, g.adj, list_transform(list_distinct(w.reg), lambda x: {{'r': x, 's': list_sum(list_transform(range(1, len(w.reg) + 1), lambda i: CASE WHEN w.reg[i] = x THEN g.ws[i] ELSE 0 END))}}) AS sizes
          FROM walk w, {{grown_cells}} g WHERE len(list_distinct(w.reg)) > {n_regions})))) WHERE len(near) > 0)
SELECT l.cell, min(l.cell) OVER (PARTITION BY l.reg) AS region, CAST(sum(l.n) OVER (PARTITION BY l.reg) AS BIGINT) AS n
FROM (SELECT unnest(g.cells) AS cell, unnest(w.reg) AS reg, unnest(g.ws) AS n FROM (SELECT * FROM walk ORDER BY step DESC LIMIT 1) w, {{grown_cells}} g) l""")


def _regions(mode: str) -> None:
    @query(f"X3_regions_{mode}", regions_sql(mode, 6))
    def _(spark, sf):
        counts = m.agents(spark, sf).where("life_state > 0").groupBy("cell").agg(F.count("*").alias("n"))
        return regions.grow_regions(m.edges(spark, sf), counts, 6, mode)


for _mode in ("smallest", "largest", "random", "all"):
    _regions(_mode)


@query("G16_region_totals", "SELECT cell % 4 AS region, count(*) AS n FROM {agents} WHERE life_state > 0 GROUP BY 1")
def _(spark, sf):
    return m.agents(spark, sf).where("life_state > 0").groupBy((F.col("cell") % 4).alias("region")).agg(F.count("*").alias("n"))


@query("X5_tiles", "SELECT cell, CAST(x // 2 AS INTEGER) AS tx, CAST(y // 2 AS INTEGER) AS ty, CASE WHEN x % 2 = 0 AND y % 2 = 0 THEN 'corner' WHEN x % 2 = 0 OR y % 2 = 0 THEN 'edge' ELSE 'inner' END AS zone FROM {cells}")
def _(spark, sf):
    x0, y0 = F.col("x") % 2 == 0, F.col("y") % 2 == 0
    zone = F.when(x0 & y0, "corner").when(x0 | y0, "edge").otherwise("inner")
    return m.cells(spark, sf).select("cell", F.floor(F.col("x") / 2).cast("int").alias("tx"), F.floor(F.col("y") / 2).cast("int").alias("ty"), zone.alias("zone"))
