"""Queries of joins, pairing, hunting and spatial look-ups."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortspark.functions.curves import great_circle, great_circle_sql, polyline_sql
from cohortspark.functions.draws import u, u_sql
from cohortspark.functions.genome import diploid_distance
from cohortspark.operators import pairing, spatial
from cohortspark.operators.components import connected_components
from cohortspark.operators.genome_pairs import distance_pairs
from cohortspark.operators.ordering import ranked
from cohortspark.plans import model as m
from cohortspark.plans.q_cells import coast
from cohortspark.plans.q_dynamics import STEP, draw
from cohortspark.registry import cte, query

SEED = 7


@query("J3_cogroup", """SELECT cell, coalesce(prey, 0) AS n_prey, coalesce(pred, 0) AS n_pred FROM (SELECT cell, count(*) AS prey FROM {agents} WHERE life_state > 0 GROUP BY cell) a
  FULL JOIN (SELECT cell, count(*) AS pred FROM {predators} WHERE life_state > 0 GROUP BY cell) b USING (cell)""")
def _(spark, sf):
    side = lambda df, n: df.where("life_state > 0").groupBy("cell").agg(F.count("*").alias(n))
    both = side(m.agents(spark, sf), "n_prey").join(side(m.predators(spark, sf), "n_pred"), "cell", "full")
    return both.select("cell", F.coalesce("n_prey", F.lit(0)).alias("n_prey"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"))


cte("able", f"""SELECT *, CASE WHEN (gender = 0) = (nf <= nm) THEN 0e0 ELSE {draw('pair')} END AS o FROM (
  SELECT *, count(*) FILTER (WHERE gender = 0) OVER (PARTITION BY cell) AS nf, count(*) FILTER (WHERE gender = 1) OVER (PARTITION BY cell) AS nm FROM {{agents}} WHERE life_state = 5)""")
cte("ranked_able", "SELECT *, row_number() OVER (PARTITION BY cell, gender ORDER BY o, id) AS i FROM {able}")
cte("pairs", "SELECT f.cell, f.id AS female, m.id AS male FROM {ranked_able} f JOIN {ranked_able} m ON f.cell = m.cell AND f.i = m.i AND f.gender = 0 AND m.gender = 1")


@query("J4_random_pair", "SELECT cell, female, male FROM {pairs}")
def _(spark, sf):
    return pairing.random_pairs(m.agents(spark, sf), SEED, STEP)


@query("J5_rand_perm_pair", f"""WITH_ SELECT f.cell, f.id AS female, m.id AS male FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY id) AS i FROM {{agents}} WHERE life_state = 5 AND gender = 0) f
  JOIN (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {draw('perm')}, id) AS i FROM {{agents}} WHERE life_state = 5 AND gender = 1) m ON f.cell = m.cell AND f.i = m.i""".replace("WITH_ ", ""))
def _(spark, sf):
    return pairing.permuted_pairs(m.agents(spark, sf), SEED, STEP)


def _hamming(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: bit_count(xor(p[1], p[2]))))"


def distance_sql(a: str, b: str) -> str:
    h = lambda x, y: _hamming(f"{a}.strand{x}", f"{b}.strand{y}")
    return f"least({h(1, 1)} + {h(2, 2)}, {h(1, 2)} + {h(2, 1)})"


cte("pair_dist", f"SELECT p.*, {distance_sql('f', 'm')} AS dist FROM {{pairs}} p JOIN {{genomes}} f ON f.id = female JOIN {{genomes}} m ON m.id = male")


def with_distance(pairs, spark, sf):
    g = m.genomes(spark, sf)
    f, male = (g.select(F.col("id").alias(n), F.col("strand1").alias(n[0] + "1"), F.col("strand2").alias(n[0] + "2")) for n in ("female", "male"))
    return pairs.join(f, "female").join(male, "male").withColumn("dist", diploid_distance(F.col("f1"), F.col("f2"), F.col("m1"), F.col("m2"))).drop("f1", "f2", "m1", "m2")


@query("J6_rand_distr_pair", f"SELECT cell, female, male, CAST(dist AS BIGINT) AS dist FROM {{pair_dist}} WHERE {draw('accept', 'female')} < CASE WHEN dist > 95 THEN 0.1e0 ELSE 1e0 - dist * 0.006e0 END")
def _(spark, sf):
    pairs = with_distance(pairing.random_pairs(m.agents(spark, sf), SEED, STEP), spark, sf)
    return pairing.accepted_pairs(pairs, F.col("dist"), 95, 0.1, 0.006, SEED, STEP).select("cell", "female", "male", "dist")


def able(spark, sf):
    """Fertile agents with their genomes."""
    a = m.agents(spark, sf).where("life_state = 5").select("id", "cell", "gender")
    return a.join(m.genomes(spark, sf).drop("cell"), "id")


cte("couples", f"""SELECT f.cell, f.id AS female, m.id AS male, {distance_sql('f', 'm')} AS dist,
  len(list_intersect(list_transform(f.strand1 || f.strand2, lambda x: x % 16), list_transform(m.strand1 || m.strand2, lambda x: x % 16))) AS shared
  FROM (SELECT a.id, a.cell, strand1, strand2 FROM {{agents}} a JOIN {{genomes}} g ON g.id = a.id WHERE life_state = 5 AND gender = 0) f
  JOIN (SELECT a.id, a.cell, strand1, strand2 FROM {{agents}} a JOIN {{genomes}} g ON g.id = a.id WHERE life_state = 5 AND gender = 1) m ON m.cell = f.cell""")


_KNOTS = [(60.0, 0.0), (90.0, 1.0), (110.0, 0.2)]
_FREE = "list_filter(list_zip(b[1].ms, b[1].ws), lambda z: NOT list_contains(list_transform(a, lambda p: p.m), z[1]))"
_TOTAL = f"coalesce(list_sum(list_transform({_FREE}, lambda z: z[2])), 0e0)"
_UPTO = f"list_transform(range(1, len({_FREE}) + 1), lambda i: list_sum(list_transform({_FREE}[1:i], lambda z: z[2])))"
_PLACE = f"least(1 + len(list_filter({_UPTO}, lambda c: c <= b[1].r * {_TOTAL})), len({_FREE}))"


@query("J7_sel_pair", f"""SELECT cell, p.f AS female, p.m AS male FROM (SELECT cell, unnest(list_reduce(list_prepend([]::STRUCT(f BIGINT, r DOUBLE, m BIGINT, ms BIGINT[], ws DOUBLE[])[], list([{{'f': female, 'r': r, 'm': NULL::BIGINT, 'ms': ms, 'ws': ws}}] ORDER BY female)),
    lambda a, b: CASE WHEN {_TOTAL} > 0 THEN list_append(a, {{'f': b[1].f, 'r': b[1].r, 'm': {_FREE}[{_PLACE}][1], 'ms': NULL::BIGINT[], 'ws': NULL::DOUBLE[]}}) ELSE a END)) AS p
  FROM (SELECT cell, female, {u_sql(SEED, STEP, 'select', 'female')} AS r, list(male ORDER BY male) AS ms, list(greatest(CAST({polyline_sql('dist', _KNOTS)} AS DOUBLE), 0e0) ORDER BY male) AS ws FROM {{couples}} GROUP BY cell, female) GROUP BY cell)""")
def _(spark, sf):
    return pairing.selected_pairs(able(spark, sf), partial(pairing.curve, knots=_KNOTS), SEED, STEP)


def greedy_sql(score: str, cutoff: float) -> str:
    """The couples of each cell in their total order, folded: a couple is taken if neither partner is."""
    order = f"-score, {u_sql(SEED, STEP, 'greedy', 'female')}, female, {u_sql(SEED, STEP, 'choose', 'female', 'male')}, male"
    taken = "CASE WHEN len(list_filter(a, lambda p: p.f = b[1].f OR p.m = b[1].m)) > 0 THEN a ELSE list_concat(a, b) END"
    return f"""SELECT cell, p.f AS female, p.m AS male, p.s AS score FROM (SELECT cell, unnest(list_reduce(list([{{'f': female, 'm': male, 's': score}}] ORDER BY {order}), lambda a, b: {taken})) AS p
      FROM (SELECT cell, female, male, CAST({score} AS DOUBLE) AS score FROM {{couples}}) WHERE score >= {cutoff}e0 GROUP BY cell)"""


@query("J8_assortative_pair", greedy_sql("shared", 1.0))
def _(spark, sf):
    """Scores: equal blocks of the strands, as shared proteins."""
    return pairing.shared_pairs(able(spark, sf), 16, 1.0, SEED, STEP)


@query("J9_assortative_pair_ham", greedy_sql("1e0 - dist / 192e0", 0.5))
def _(spark, sf):
    return pairing.assortative_pairs(able(spark, sf), partial(pairing.likeness, loci=96.0), 0.5, SEED, STEP)


@query("J10_rank_table_pairs", greedy_sql("floor(dist / 10e0)", 8.0))
def _(spark, sf):
    return pairing.assortative_pairs(able(spark, sf), pairing.tens, 8.0, SEED, STEP)


cte("prey_ranked", f"SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {draw('prey')}, id) AS i FROM {{agents}} WHERE life_state > 0")


@query("J11_hunting", f"""SELECT p.cell, p.id AS pred, y.id AS prey, round(y.mass * 0.3e0, 6) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY id) AS i FROM {{predators}}) p
  JOIN {{prey_ranked}} y ON p.cell = y.cell AND p.i = y.i WHERE {draw('hunt', 'p.id')} < 0.7e0""")
def _(spark, sf):
    out = pairing.hunt(m.predators(spark, sf), m.agents(spark, sf), 0.7, 0.3, SEED, STEP)
    return out.withColumn("gain", F.round("gain", 6))


cte("two_species", "SELECT *, id % 2 AS species FROM {predators}")
cte("assigned", f"""SELECT y.cell, y.id AS prey, p.id AS pred, p.species FROM (SELECT a.*, CAST(least(floor({draw('which', 'a.id')} * n), n - 1) AS BIGINT) AS k FROM {{agents}} a
    JOIN (SELECT cell, count(*) AS n FROM {{predators}} GROUP BY cell) t ON t.cell = a.cell WHERE life_state > 0 AND {draw('kept', 'a.id')} < 0.4e0) y
  JOIN (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY species, id) - 1 AS k FROM {{two_species}}) p ON p.cell = y.cell AND p.k = y.k""")


def assigned(spark, sf):
    preds = m.predators(spark, sf).withColumn("species", F.col("id") % 2)
    return pairing.distribute_prey(m.agents(spark, sf), preds, 0.4, SEED, STEP)


@query("J12_prey_distributor", "SELECT cell, prey, pred, species FROM {assigned}")
def _(spark, sf):
    return assigned(spark, sf)


@query("J13_pd_hunting", "SELECT pred, count(*) AS n_prey, round(sum(mass * 0.3e0), 6) AS gain FROM {assigned} JOIN {agents} a ON a.id = prey GROUP BY pred")
def _(spark, sf):
    return pairing.consume(assigned(spark, sf), m.agents(spark, sf), 0.3).withColumn("gain", F.round("gain", 6))


@query("W3_cumulative_predators", "SELECT cell, species, sum(n) OVER (PARTITION BY cell ORDER BY species ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM (SELECT cell, species, count(*) AS n FROM {two_species} GROUP BY cell, species)")
def _(spark, sf):
    n = m.predators(spark, sf).groupBy("cell", (F.col("id") % 2).alias("species")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("cell").orderBy("species").rowsBetween(Window.unboundedPreceding, 0)
    return n.select("cell", "species", F.sum("n").over(w).alias("upto"))


GC = great_circle_sql("c.lon", "c.lat", "l.lon", "l.lat")
cte("in_reach", f"SELECT a.id, a.cell, l.name, l.num, {GC} AS d FROM {{agents}} a JOIN {{cells}} c ON c.cell = a.cell JOIN {{locations}} l ON {GC} < l.dist WHERE life_state > 0")


def in_reach(spark, sf):
    a = m.agents(spark, sf).where("life_state > 0").select("id", "cell").join(m.cells(spark, sf).select("cell", "lon", "lat"), "cell")
    return spatial.radius_join(a, m.locations(spark, sf), 2000.0, "dist").select("id", "cell", "name", "num", "d")


@query("J14_radius_join_all", "SELECT id, name, round(d, 6) AS d FROM {in_reach}")
def _(spark, sf):
    return in_reach(spark, sf).select("id", "name", F.round("d", 6).alias("d"))


@query("J14_radius_join_first", "SELECT id, min(name) AS name FROM {in_reach} GROUP BY id")
def _(spark, sf):
    return spatial.first_place(in_reach(spark, sf), ["id"], "name").select("id", "name")


@query("W5_sample_per_location", f"SELECT name, id FROM (SELECT name, id, num, row_number() OVER (PARTITION BY name ORDER BY {draw('sample', 'id')}, id) AS n FROM {{in_reach}}) WHERE num < 0 OR n <= num")
def _(spark, sf):
    drawn = in_reach(spark, sf).withColumn("o", u(SEED, STEP, "sample", F.col("id")))
    return ranked(drawn, ["name"], ["o", "id"], "n").where("num < 0 or n <= num").select("name", "id")


@query("W4_sample_per_group", f"SELECT cell, id FROM (SELECT cell, id, row_number() OVER (PARTITION BY cell ORDER BY {draw('take')}, id) AS n FROM {{agents}}) WHERE n <= 4")
def _(spark, sf):
    drawn = m.agents(spark, sf).select("cell", "id", u(SEED, STEP, "take", F.col("id")).alias("o"))
    return ranked(drawn, ["cell"], ["o", "id"], "n").where("n <= 4").select("cell", "id")


AB = great_circle_sql("a.lon", "a.lat", "b.lon", "b.lat")


@query("J15_nearest_visited", f"""SELECT a.cell, CAST(coalesce(b.place, -1) AS INTEGER) AS place, round(coalesce(b.d, -1e0), 6) AS d FROM {{cells}} a LEFT JOIN (
  SELECT a.cell, min({{'d': {AB}, 'place': b.cell}}) AS b FROM {{cells}} a JOIN {{cells}} b ON b.cell % 6 = 2 AND {AB} < 1500 GROUP BY a.cell) n ON n.cell = a.cell""")
def _(spark, sf):
    c = m.cells(spark, sf)
    places = c.where("cell % 6 = 2").withColumnRenamed("cell", "place")
    return spatial.nearest_within(c, places, "cell", "place", 1500.0).withColumn("d", F.round("d", 6))


@query("J16_snap_to_lattice", f"""SELECT cell, glon, glat FROM (SELECT cell, lon, lat, round(lon / 15) * 15 AS glon, round(lat / 15) * 15 AS glat FROM {{cells}})
  WHERE {great_circle_sql('lon', 'lat', 'glon', 'glat')} < 600""")
def _(spark, sf):
    return spatial.snap(m.cells(spark, sf), 15.0, 600.0).select("cell", "glon", "glat")


cte("coast_at", "SELECT c.* FROM {cells} c JOIN {coast} k ON k.cell = c.cell")


@query("J17_coast_ranges", f"SELECT a.cell AS a, b.cell AS b, round({AB}, 6) AS d FROM {{coast_at}} a JOIN {{coast_at}} b ON a.cell < b.cell AND {AB} < 2500")
def _(spark, sf):
    at = m.cells(spark, sf).join(coast(spark, sf), "cell", "left_semi")
    return spatial.range_pairs(at, "cell", 2500.0).withColumn("d", F.round("d", 6))


def seaways(spark, sf):
    """Coast cells, components of the land, ranges between components, mutual shortest links."""
    land = m.env(spark, sf).where("altitude > 0").select("cell")
    e = m.edges(spark, sf).join(land, "cell", "left_semi").join(land.withColumnRenamed("cell", "nbr"), "nbr", "left_semi")
    parts = connected_components(e, "cell", "nbr")
    comp = land.join(parts, F.col("cell") == F.col("node"), "left").select("cell", F.coalesce("component", "cell").alias("comp"))
    at = m.cells(spark, sf).join(coast(spark, sf), "cell", "left_semi")
    r = spatial.range_pairs(at, "cell", 6000.0)
    both = r.select(F.col("a").alias("src"), F.col("b").alias("dst"), "d").unionByName(r.select(F.col("b").alias("src"), F.col("a").alias("dst"), "d"))
    both = both.join(comp.select(F.col("cell").alias("src"), F.col("comp").alias("src_comp")), "src").join(comp.select(F.col("cell").alias("dst"), F.col("comp").alias("dst_comp")), "dst")
    return spatial.mutual_shortest_links(both)


cte("land_pairs", "SELECT g.cell AS a, g.nbr AS b FROM {edges} g JOIN {env} x ON x.cell = g.cell AND x.altitude > 0 JOIN {env} y ON y.cell = g.nbr AND y.altitude > 0")
SEAWAYS = f"""WITH RECURSIVE reach(a, b) AS (SELECT cell, cell FROM {{env}} WHERE altitude > 0 UNION SELECT r.a, p.b FROM reach r JOIN {{land_pairs}} p ON p.a = r.b),
comp AS (SELECT a AS cell, min(b) AS comp FROM reach GROUP BY a),
links AS (SELECT a.cell AS src, b.cell AS dst, ca.comp AS sc, cb.comp AS dc, {AB} AS d FROM {{coast_at}} a JOIN {{coast_at}} b ON {AB} < 6000 JOIN comp ca ON ca.cell = a.cell JOIN comp cb ON cb.cell = b.cell WHERE ca.comp <> cb.comp),
best AS (SELECT src, min({{'d': d, 'dst': dst}}) AS b FROM links GROUP BY src, sc, dc)
SELECT x.src, x.b.dst AS dst, round(x.b.d, 6) AS d FROM best x SEMI JOIN (SELECT src AS dst, b.dst AS src FROM best) y ON y.src = x.src AND y.dst = x.b.dst"""


def recursive_sql(sql: str) -> str:
    """Puts the needed sub-queries in front of those of a recursive query."""
    from cohortspark.registry import with_ctes

    body = sql.removeprefix("WITH RECURSIVE ")
    flat = with_ctes(body)
    if flat.startswith("WITH "):
        head, _, rest = flat.removeprefix("WITH ").rpartition(")\n" + body.split("(", 1)[0] + "(")
        return "WITH RECURSIVE " + head + "),\n" + body.split("(", 1)[0] + "(" + rest
    return "WITH RECURSIVE " + flat


@query("J18_mutual_links", recursive_sql(SEAWAYS))
def _(spark, sf):
    return seaways(spark, sf).withColumn("d", F.round("d", 6))


@query("X4_seaways_table", recursive_sql(SEAWAYS).replace("SELECT x.src, x.b.dst AS dst, round(x.b.d, 6) AS d", "SELECT x.src AS port, count(*) AS n_dest, round(min(x.b.d), 6) AS nearest") + " GROUP BY x.src")
def _(spark, sf):
    return seaways(spark, sf).groupBy(F.col("src").alias("port")).agg(F.count("*").alias("n_dest"), F.round(F.min("d"), 6).alias("nearest"))


def distances(spark, sf, others="true"):
    """``a, b, dist``: the sample (every id divisible by 50) against all (``others``) but itself."""
    g = m.genomes(spark, sf)
    return distance_pairs(g.where("id % 50 = 0"), g.where(others))


cte("sample_dist", f"SELECT x.id AS a, y.id AS b, CAST({distance_sql('x', 'y')} AS BIGINT) AS dist FROM {{sampled_genomes}} x JOIN {{genomes}} y ON x.id <> y.id")


@query("J19_distance_matrix", "SELECT a, b, dist FROM {sample_dist}")
def _(spark, sf):
    """The rows of the reference's matrix that belong to the sample, against all genomes in packed blocks."""
    return distances(spark, sf)


@query("J19_cross_matrix", "SELECT a, b, dist FROM {sample_dist} WHERE b % 2 = 1")
def _(spark, sf):
    """Rectangular: one set against the other (the reference compares the second with itself)."""
    return distances(spark, sf, "id % 2 = 1")


@query("J20_node_stats", "SELECT a.id, a.cell, n FROM {agents} a JOIN {counts} c ON c.cell = a.cell")
def _(spark, sf):
    stats = m.agents(spark, sf).where("life_state > 0").groupBy("cell").agg(F.count("*").alias("n"))
    return m.agents(spark, sf).join(stats, "cell").select("id", "cell", "n")


@query("J21_column_merge", "SELECT a.r, c_name, s_name FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS r, c_name FROM customer) a JOIN (SELECT row_number() OVER (ORDER BY s_suppkey) AS r, s_name FROM supplier) b USING (r)")
def _(spark, sf):
    from cohortspark.sources.text import paste

    c = m.table(spark, sf, "customer").select("c_custkey", "c_name")
    s = m.table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return paste(c, ["c_custkey"], s, ["s_suppkey"]).select("r", "c_name", "s_name")


@query("J22_asof_environment", """SELECT e.event_id, last_value(CASE WHEN src = 0 THEN e.value END IGNORE NULLS) OVER (ORDER BY e.ts, src, e.event_id ROWS UNBOUNDED PRECEDING) AS env_value FROM (
  SELECT *, 0 AS src FROM events WHERE event_id % 10 = 0 UNION ALL SELECT *, 1 AS src FROM events WHERE event_id % 10 <> 0) e QUALIFY src = 1""".replace("SELECT e.event_id, last", "SELECT e.event_id, round(last").replace(" ROWS UNBOUNDED PRECEDING) AS env_value", " ROWS UNBOUNDED PRECEDING), 6) AS env_value"))
def _(spark, sf):
    """Each event with the value of the latest environment event at or before it, by key ranges (see ``asof``)."""
    from cohortspark.operators.asof import asof

    e = m.table(spark, sf, "events").select("event_id", "ts", "value")
    env = e.where("event_id % 10 = 0").select("ts", F.col("value").alias("env_value"), F.col("event_id").alias("tie"))
    return asof(e.where("event_id % 10 <> 0").select("event_id", "ts"), env, "ts", "env_value", "tie").select("event_id", F.round("env_value", 6).alias("env_value"))


@query("J23_semi_anti", "SELECT 'semi' AS kind, cell FROM {env} WHERE cell IN (SELECT cell FROM {coast}) UNION ALL SELECT 'anti', cell FROM {env} WHERE cell NOT IN (SELECT cell FROM {coast})")
def _(spark, sf):
    e, k = m.env(spark, sf).select("cell"), coast(spark, sf)
    return e.join(k, "cell", "left_semi").select(F.lit("semi").alias("kind"), "cell").unionByName(e.join(k, "cell", "left_anti").select(F.lit("anti").alias("kind"), "cell"))
