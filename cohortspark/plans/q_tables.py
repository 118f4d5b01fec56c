"""Queries of sources, sinks, sorting, sets, texts, triggers and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortspark.functions.draws import u, u_sql
from cohortspark.functions.genome import to_text
from cohortspark.operators.genetics import binomial_count, binomial_table
from cohortspark.plans import model as m
from cohortspark.plans.q_dynamics import draw
from cohortspark.registry import cte, query
from cohortspark.sources import text as tx
from cohortspark.streaming import triggers as tr


@query("S1_read_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, sf):
    return m.table(spark, sf, "nation")


@query("S2_column_scan", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY l_returnflag")
def _(spark, sf):
    """Two columns and a pushed filter reach the scan."""
    return m.table(spark, sf, "lineitem").where("l_quantity > 45").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("S3_array_column", "SELECT vec_id, len(embedding) AS n, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings WHERE label = 1")
def _(spark, sf):
    e = m.table(spark, sf, "embeddings").where("label = 1")
    return e.select("vec_id", F.size("embedding").cast("bigint").alias("n"), F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"))


@query("S4_attributes", "SELECT 'r' || r_regionkey AS key, r_name AS value FROM region")
def _(spark, sf):
    return m.table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("key"), F.col("r_name").alias("value"))


@query("S5_field_slab", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 180")
def _(spark, sf):
    return m.table(spark, sf, "orders").where("o_orderkey between 100 and 180").select("o_orderkey", "o_totalprice")


@query("S11_text_agents", "SELECT c.lon, c.lat, CAST(a.life_state AS DOUBLE) AS life, CAST(a.id AS DOUBLE) AS id, birth_time AS birth, CAST(gender AS DOUBLE) AS gender, false AS bad FROM {agents} a JOIN {cells} c ON c.cell = a.cell")
def _(spark, sf):
    """Agents written as text lines and parsed back."""
    a = m.agents(spark, sf).join(m.cells(spark, sf).select("cell", "lon", "lat"), "cell")
    parts = [F.col(c).cast("string") for c in ("life_state", "id", "birth_time", "gender")]
    lines = a.select(F.concat(F.col("lon").cast("string"), F.lit("  "), F.col("lat").cast("string"), F.lit(" : "), F.concat_ws(" ", *parts), F.lit(" # note")).alias("value"))
    return tx.parse_agents(lines, ["life", "id", "birth", "gender"])


@query("S18_last_write_wins", "SELECT CAST(l_suppkey % 25 AS BIGINT) AS cell, (max({'o': l_orderkey * 10 + l_linenumber, 'v': l_quantity})).v AS v FROM lineitem GROUP BY 1")
def _(spark, sf):
    """River points into cells: the last point written to a cell keeps its attribute."""
    li = m.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 25).alias("cell"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), "l_quantity")
    return li.groupBy("cell").agg(F.max_by("l_quantity", "o").alias("v"))


@query("S20_plink_ped", """SELECT id, CAST(id % 2 AS INTEGER) AS gender, id // 2 AS mom, id // 3 AS dad, (SELECT string_agg(substr('AGCT', CAST((strand1[l // 16 + 1] >> (l % 16 * 2)) & 3 AS INTEGER) + 1, 1), '' ORDER BY l) FROM range(48) t(l)) AS strand1,
  (SELECT string_agg(substr('AGCT', CAST((strand2[l // 16 + 1] >> (l % 16 * 2)) & 3 AS INTEGER) + 1, 1), '' ORDER BY l) FROM range(48) t(l)) AS strand2 FROM {genomes}""")
def _(spark, sf):
    """Written as ped lines and parsed back."""
    a, b = (to_text(F.col(s), 32, 48) for s in ("strand1", "strand2"))
    pairs = F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.concat_ws(" ", x, y)), " ")
    i = F.col("id")
    g = m.genomes(spark, sf).select("id", (i % 2).cast("int").alias("gender"), F.floor(i / 2).alias("mom"), F.floor(i / 3).alias("dad"), pairs.alias("pairs"))
    return tx.parse_ped(tx.ped_lines(g))


@query("S23_value_colours", "SELECT cell, CASE WHEN altitude < -100 THEN '#00008b' WHEN altitude < 0 THEN '#4682b4' WHEN altitude < 100 THEN '#228b22' ELSE '#a0522d' END AS rgb FROM {env}")
def _(spark, sf):
    h = F.col("altitude")
    rgb = F.when(h < -100, "#00008b").when(h < 0, "#4682b4").when(h < 100, "#228b22").otherwise("#a0522d")
    return m.env(spark, sf).select("cell", rgb.alias("rgb"))


@query("S27a_navigation_runs", "SELECT cell, count(*) AS multiplicity, string_agg(CAST(nbr AS VARCHAR), ' ' ORDER BY nbr) AS ids FROM {edges} GROUP BY cell")
def _(spark, sf):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("nbr")), lambda n: n.cast("string")), " ")
    return m.edges(spark, sf).groupBy("cell").agg(F.count("*").alias("multiplicity"), ids.alias("ids"))


@query("S27b_parameter_sweep", "SELECT k, b, round(t / 100e0, 6) AS theta FROM (VALUES (10), (50), (100), (500)) x(k), range(1, 4) y(b), range(1, 10, 4) z(t)")
def _(spark, sf):
    k = spark.createDataFrame([(10,), (50,), (100,), (500,)], "k int")
    b = spark.range(1, 4).withColumnRenamed("id", "b")
    t = spark.range(1, 10, 4).select(F.round(F.col("id") / 100.0, 6).alias("theta"))
    return k.crossJoin(b).crossJoin(t)  # a sweep is the product of its short lists


@query("S27c_event_list", "SELECT i * 1000 AS t, 'env|geo+climate:world_' || lpad(CAST(80 - i AS VARCHAR), 3, '0') || 'k@[' || i * 1000 || ']' AS line FROM range(0, 81) r(i)")
def _(spark, sf):
    i = F.col("id")
    line = F.concat(F.lit("env|geo+climate:world_"), F.lpad((80 - i).cast("string"), 3, "0"), F.lit("k@["), (i * 1000).cast("string"), F.lit("]"))
    return spark.range(0, 81).select((i * 1000).alias("t"), line.alias("line"))


@query("S28_transform_schema", "SELECT id, cell, CAST(gender AS INTEGER) AS gender, 0e0 AS baby_mass, CAST(-1 AS BIGINT) AS prey FROM {agents} UNION ALL SELECT id, cell, CAST(gender AS INTEGER), NULL, CAST(7 AS BIGINT) FROM {predators}")
def _(spark, sf):
    a = m.agents(spark, sf).select("id", "cell", "gender", F.lit(0.0).alias("baby_mass"), F.lit(-1).cast("bigint").alias("prey"))
    p = m.predators(spark, sf).select("id", "cell", "gender", F.lit(7).cast("bigint").alias("prey"))
    return a.unionByName(p, allowMissingColumns=True)


@query("O1_sorted_ancestors", "SELECT CAST(row_number() OVER (ORDER BY time, id) AS INTEGER) AS r, id, time FROM {ancestors} QUALIFY r <= 500")
def _(spark, sf):
    """A top-k report in order (the full sort is ``orderBy``)."""
    first = m.ancestors(spark, sf).orderBy("time", "id").limit(500)
    return first.select(F.row_number().over(Window.orderBy("time", "id")).alias("r"), "id", "time")


@query("O2_merge_sorted", "SELECT id, mom FROM {ancestors}")
def _(spark, sf):
    a = m.ancestors(spark, sf)
    return a.where("id % 2 = 0").unionByName(a.where("id % 2 <> 0")).select("id", "mom").orderBy("id")


@query("O4_partial_shuffle", f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY {draw('shuffle')}, id) AS n FROM {{agents}}) WHERE n <= 50")
def _(spark, sf):
    return m.agents(spark, sf).orderBy(u(7, 3, "shuffle", F.col("id")), "id").limit(50).select("id")


@query("O6_first_arrival_per_cell", "SELECT target, min(step) AS step, (min({'s': step, 'id': id})).id AS id FROM {moves} GROUP BY target")
def _(spark, sf):
    first = m.moves(spark, sf).groupBy("target").agg(F.min(F.struct("step", "id")).alias("f"))
    return first.select("target", "f.step", "f.id")


@query("O7_closest_to_origin", "SELECT name, (min({'d': d, 'id': id})).id AS id FROM {in_reach} GROUP BY name")
def _(spark, sf):
    from cohortspark.plans.q_joins import in_reach

    return in_reach(spark, sf).groupBy("name").agg(F.min(F.struct("d", "id")).alias("b")).select("name", "b.id")


@query("O8_intersection", "SELECT source AS cell FROM {moves} WHERE step % 2 = 0 INTERSECT SELECT target FROM {moves} WHERE step % 7 = 0")
def _(spark, sf):
    mv = m.moves(spark, sf)
    return mv.where("step % 2 = 0").select(F.col("source").alias("cell")).intersect(mv.where("step % 7 = 0").select("target"))


@query("O9_union_difference", "SELECT 'union' AS kind, cell FROM (SELECT cell FROM {cells} WHERE cell < 9 UNION SELECT nbr FROM {edges} WHERE cell = 20) UNION ALL SELECT 'except', cell FROM (SELECT nbr AS cell FROM {edges} WHERE cell IN (3, 8) EXCEPT SELECT cell FROM {cells} WHERE cell < 9)")
def _(spark, sf):
    low = m.cells(spark, sf).where("cell < 9").select("cell")
    e = m.edges(spark, sf)
    both = low.unionByName(e.where("cell = 20").select(F.col("nbr").alias("cell"))).distinct()
    rest = e.where("cell in (3, 8)").select(F.col("nbr").alias("cell")).exceptAll(low).distinct()
    return both.select(F.lit("union").alias("kind"), "cell").unionByName(rest.join(low, "cell", "left_anti").select(F.lit("except").alias("kind"), "cell"))


@query("O10_id_search", "SELECT id, mom, dad FROM {ancestors} WHERE id IN (5, 77, 411)")
def _(spark, sf):
    return m.ancestors(spark, sf).where(F.col("id").isin(5, 77, 411)).select("id", "mom", "dad")


@query("G18_distinct", "SELECT count(DISTINCT source) AS sources, count(DISTINCT source * 100 + target) AS routes FROM {moves}")
def _(spark, sf):
    return m.moves(spark, sf).agg(F.count_distinct("source").alias("sources"), F.count_distinct(F.col("source") * 100 + F.col("target")).alias("routes"))


@query("G17_partial_final", "SELECT source, target, count(*) AS n, min(step) AS first FROM {moves} GROUP BY source, target")
def _(spark, sf):
    return m.moves(spark, sf).groupBy("source", "target").agg(F.count("*").alias("n"), F.min("step").alias("first"))


@query("G14_growth_means", "SELECT cell, round(avg(n), 6) AS mean, round(var_pop(n), 6) AS var FROM (SELECT source AS cell, step % 50 AS t, count(*) AS n FROM {moves} GROUP BY 1, 2) WHERE n > 0 GROUP BY cell")
def _(spark, sf):
    n = m.moves(spark, sf).groupBy(F.col("source").alias("cell"), (F.col("step") % 50).alias("t")).agg(F.count("*").alias("n"))
    return n.where("n > 0").groupBy("cell").agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.var_pop("n"), 6).alias("var"))


@query("P14_wildcards", r"SELECT c_custkey, regexp_extract(c_name, '^(.*)\#([0-9]+)7$', 2) AS captured FROM customer WHERE regexp_matches(c_name, '^(.*)\#([0-9]+)7$')")
def _(spark, sf):
    pattern = tx.wildcard_regex("*#7").replace("(.*)([0-9]+)", r"(.*)\#([0-9]+)")  # names hold a literal '#'
    c = m.table(spark, sf, "customer")
    return c.where(F.col("c_name").rlike(pattern)).select("c_custkey", F.regexp_extract("c_name", pattern, 2).alias("captured"))


@query("F1_strings", "SELECT c_custkey, trim('  ' || c_name || ' ') AS trimmed, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded, ends_with(c_mktsegment, 'Y') AS y, replace(c_mktsegment, 'U', 'u') AS replaced FROM customer")
def _(spark, sf):
    return m.table(spark, sf, "customer").select(
        "c_custkey", F.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("trimmed"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"),
        F.endswith("c_mktsegment", F.lit("Y")).alias("y"), F.replace("c_mktsegment", F.lit("U"), F.lit("u")).alias("replaced"),
    )


@query("F2_checksums", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def _(spark, sf):
    return m.table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), F.sha2("text", 256).alias("sha256"))


_LOW, _BIN = binomial_table(96, 0.02)


@query("F3_binomial_draws", f"SELECT id, {_LOW} + " + " + ".join(f"({u_sql(4, 4, 'bino', 'id')} >= {t!r}::DOUBLE)::INT" for t in _BIN) + " AS n FROM {agents}")
def _(spark, sf):
    return m.agents(spark, sf).select("id", binomial_count(u(4, 4, "bino", F.col("id")), 96, 0.02).alias("n"))


@query("F4_linlog", "SELECT cell, round(CASE WHEN altitude > 0 THEN 1 + ln(1 + altitude) ELSE 1 + altitude END, 6) AS v FROM {env}")
def _(spark, sf):
    h = F.col("altitude")
    return m.env(spark, sf).select("cell", F.round(F.when(h > 0, 1 + F.log1p(F.greatest(h, F.lit(0.0)))).otherwise(1 + h), 6).alias("v"))


EVENTS = [("write|pop", "-20"), ("env|geo", "[:10]2"), ("dump", "[3]+[7]+[44:]"), ("check", "[-3:]"), ("arr", "15"), ("comm", "final")]
END = 50.0
cte("firing", """SELECT 'write|pop' AS event, t FROM generate_series(10, 50, 20) g(t) UNION ALL SELECT 'write|pop', unnest([0, 50]) UNION ALL SELECT 'env|geo', t FROM generate_series(0, 10, 2) g(t)
  UNION ALL SELECT 'dump', unnest([3, 7, 44, 45, 46, 47, 48, 49, 50]) UNION ALL SELECT 'check', t FROM generate_series(47, 50) g(t) UNION ALL SELECT 'arr', t FROM generate_series(0, 50, 15) g(t) UNION ALL SELECT 'comm', 50""")


@query("T3_schedule", "SELECT CAST(t AS DOUBLE) AS time, string_agg(DISTINCT event, ',' ORDER BY event) AS events FROM {firing} GROUP BY t")
def _(spark, sf):
    return tr.schedule(spark, EVENTS, END).select("time", F.array_join("events", ",").alias("events"))


@query("T1_trigger_times", "SELECT event, CAST(t AS DOUBLE) AS time FROM (SELECT DISTINCT event, t FROM {firing})")
def _(spark, sf):
    return tr.schedule(spark, EVENTS, END).select(F.explode("events").alias("event"), "time")


@query("W6_interval_flattening", "SELECT * FROM (VALUES (0e0, 10e0), (20e0, 3e0), (30e0, 4e0), (41e0, 3e0), (60e0, 10e0), (100e0, 'infinity'::DOUBLE)) t(time, step)".replace("'infinity'::DOUBLE", "-1e0"))
def _(spark, sf):
    flat = tr.linearize([(0, 100, 10), (20, 55, 3), (30, 41, 4)])
    rows = [(float(t), -1.0 if math.isinf(s) else float(s)) for t, s in flat]
    return spark.createDataFrame(rows, "time double, step double")


@query("T4_event_kinds", "SELECT event_type AS kind, count(*) AS n, min(event_id) AS first FROM events GROUP BY event_type")
def _(spark, sf):
    return m.table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
