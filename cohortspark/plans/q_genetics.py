"""Queries over genomes and phenomes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cohortspark.functions import genome as g
from cohortspark.functions.draws import u, u_sql
from cohortspark.functions.genome import diploid_distance
from cohortspark.functions.lineage import cut
from cohortspark.operators import genetics as ge
from cohortspark.operators.genome_pairs import distance_sums, numbered_distance_pairs
from cohortspark.operators.ordering import against_all, numbered
from cohortspark.plans import model as m
from cohortspark.plans.q_joins import distance_sql
from cohortspark.registry import cte, query

BITS, BLOCKS = ge.BLOCK_BITS, 3
LOCI = BITS * BLOCKS


def block_sql(tag: str, *parts: str, at: int = 1) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{tag}', {', '.join(parts)})), {at}, 8))::BIGINT"


def mask_sql(tag: str, id_: str = "id") -> str:
    return "[" + ", ".join(block_sql(tag, id_, at=1 + 8 * b) for b in range(BLOCKS)) + "]"


cte("neighbours60", "SELECT a.id, a.strand1 AS a1, a.strand2 AS a2, b.strand1 AS b1, b.strand2 AS b2 FROM {genomes} a JOIN {genomes} b ON b.id = a.id + 1")


def neighbours(spark, sf):
    x = m.genomes(spark, sf)
    return x.select("id", F.col("strand1").alias("a1"), F.col("strand2").alias("a2")).join(x.select((F.col("id") - 1).alias("id"), F.col("strand1").alias("b1"), F.col("strand2").alias("b2")), "id")


@query("E1_hamming_diploid", f"SELECT a.id, CAST({distance_sql('a', 'b')} AS BIGINT) AS dist FROM {{genomes}} a JOIN {{genomes}} b ON b.id = a.id + 1")
def _(spark, sf):
    return neighbours(spark, sf).select("id", g.diploid_distance(*map(F.col, ("a1", "a2", "b1", "b2"))).alias("dist"))


_E = g.EVEN_BITS
_H2 = f"list_sum(list_transform(list_zip(a1, b1), lambda p: bit_count((xor(p[1], p[2]) | (xor(p[1], p[2]) >> 1)) & {_E})))"


@query("E2_hamming_2bit", f"SELECT id, CAST({_H2} AS BIGINT) AS dist FROM {{neighbours60}}")
def _(spark, sf):
    return neighbours(spark, sf).select("id", g.popcount2_distance(F.col("a1"), F.col("b1")).alias("dist"))


def blocks_sql(per_block: str) -> str:
    """An expression of block i (0-based) as a text key of all blocks."""
    return "concat_ws('-', " + ", ".join(per_block.replace("{i}", str(i)).replace("{j}", str(i + 1)) for i in range(BLOCKS)) + ")"


def key_of(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "-")


PLACES = "[" + ", ".join(block_sql("mut", "id", f"'{k}'") + f" % {LOCI}" for k in (1, 2, 3)) + "]"


@query("E3_mutation", f"SELECT id, {blocks_sql('list_reduce(list_prepend(strand1[{j}], list_transform(list_filter(p, lambda x: x // 32 = {i}), lambda x: 1::BIGINT << (x % 32))), lambda a, b: a | b)')} AS mutated FROM (SELECT *, {PLACES} AS p FROM {{genomes}})")
def _(spark, sf):
    places = ge.random_places("mut", F.col("id"), 3, LOCI)
    return m.genomes(spark, sf).select("id", key_of(g.mutate(F.col("strand1"), places, BITS, BLOCKS)).alias("mutated"))


BREAKS = "[" + ", ".join(block_sql("break", "id", f"'{k}'") + f" % {LOCI}" for k in (1, 2)) + "]"
_XMASK = "list_reduce(list_transform(p, lambda x: CASE WHEN x - {i} * 32 >= 32 THEN 0::BIGINT ELSE 4294967295 - ((1::BIGINT << greatest(x - {i} * 32, 0)) - 1) END), lambda a, b: xor(a, b))"


@query("E4_crossover", f"SELECT id, {blocks_sql(f'(strand1[{{j}}] & ~({_XMASK})) | (strand2[{{j}}] & {_XMASK})')} AS crossed FROM (SELECT *, {BREAKS} AS p FROM {{genomes}})")
def _(spark, sf):
    breaks = ge.random_places("break", F.col("id"), 2, LOCI)
    return m.genomes(spark, sf).select("id", key_of(g.crossover(F.col("strand1"), F.col("strand2"), breaks, BITS)).alias("crossed"))


@query("E5_free_recombination", f"SELECT id, {blocks_sql('(strand1[{j}] & k[{j}]) | (strand2[{j}] & ~k[{j}])')} AS mixed FROM (SELECT *, {mask_sql('free')} AS k FROM {{genomes}})")
def _(spark, sf):
    return m.genomes(spark, sf).select("id", key_of(g.free_recombination(F.col("strand1"), F.col("strand2"), ge.random_mask("free", F.col("id"), BLOCKS))).alias("mixed"))


def _gamete_sql(a: str, b: str, who: str) -> str:
    first = blocks_sql(f"({a}[{{j}}] & k{who}[{{j}}]) | ({b}[{{j}}] & ~k{who}[{{j}}])")
    second = blocks_sql(f"({b}[{{j}}] & k{who}[{{j}}]) | ({a}[{{j}}] & ~k{who}[{{j}}])")
    return f"CASE WHEN {u_sql(3, 5, f'pick|{who}', 'id')} < 0.5 THEN {first} ELSE {second} END"


@query("E6_offspring", f"SELECT id, {_gamete_sql('a1', 'a2', 'm')} AS strand1, {_gamete_sql('b1', 'b2', 'd')} AS strand2 FROM (SELECT *, {mask_sql('3|5|mask|m')} AS km, {mask_sql('3|5|mask|d')} AS kd FROM {{neighbours60}})")
def _(spark, sf):
    """Free recombination of two parents without mutations (rate 0; mutations are E3's)."""
    p = neighbours(spark, sf).withColumnsRenamed({"a1": "m1", "a2": "m2", "b1": "d1", "b2": "d2"})
    out = ge.offspring(p, BLOCKS, LOCI, 3, 5, breaks=-1, rate=0.0)
    return out.select("id", key_of("strand1").alias("strand1"), key_of("strand2").alias("strand2"))


_SLOW, _STABLE = ge.binomial_table(LOCI, 0.02)


def _mutant_sql(a: str, b: str, who: str) -> str:
    """A gamete by two breaks and mutations; ``p`` holds the breaks, ``q`` the mutations of this parent."""
    mask = _XMASK.replace("(p,", f"(p{who},")
    first, second = (f"(({x}[{{j}}] & ~({mask})) | ({y}[{{j}}] & {mask}))" for x, y in ((a, b), (b, a)))
    bits = f"list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(q{who}, lambda x: x // 32 = {{i}}), lambda x: 1::BIGINT << (x % 32))), lambda x, y: x | y)"
    return blocks_sql(f"(CASE WHEN {u_sql(3, 5, f'pick|{who}', 'id')} < 0.5 THEN {first} ELSE {second} END | {bits})")


def _places_sql(who: str) -> str:
    breaks = ", ".join(f"{block_sql(f'3|5|break|{who}', 'id', chr(39) + str(k) + chr(39))} % {LOCI}" for k in (1, 2))
    n = f"{_SLOW} + len(list_filter([{', '.join(f'{t!r}::DOUBLE' for t in _STABLE)}], lambda t: {u_sql(3, 5, f'nmut|{who}', 'id')} >= t))"
    return f"[{breaks}] AS p{who}, list_transform(range(1, {n} + 1), lambda k: ('0x' || substr(md5(concat_ws('|', '3|5|mut|{who}', id, k)), 1, 8))::BIGINT % {LOCI}) AS q{who}"


@query("E6_offspring_mutating", f"SELECT id, {_mutant_sql('a1', 'a2', 'm')} AS strand1, {_mutant_sql('b1', 'b2', 'd')} AS strand2 FROM (SELECT *, {_places_sql('m')}, {_places_sql('d')} FROM {{neighbours60}})")
def _(spark, sf):
    p = neighbours(spark, sf).withColumnsRenamed({"a1": "m1", "a2": "m2", "b1": "d1", "b2": "d2"})
    out = ge.offspring(p, BLOCKS, LOCI, 3, 5, breaks=2, rate=0.02)
    return out.select("id", key_of("strand1").alias("strand1"), key_of("strand2").alias("strand2"))


LONG_LOCI, LONG_RATE = 8192, 0.01
_LOW, _TABLE = ge.binomial_table(LONG_LOCI, LONG_RATE)
_N_MUT = f"{_LOW} + len(list_filter([{', '.join(f'{t!r}::DOUBLE' for t in _TABLE)}], lambda t: d >= t))"
_PLACE = f"('0x' || substr(md5(concat_ws('|', '3|5|mut|m', id, k)), 1, 8))::BIGINT % {LONG_LOCI}"


@query("E6_offspring_long_genome", f"""SELECT id, n_mutations, count(DISTINCT place) AS n_set, CAST(sum(DISTINCT place) AS BIGINT) AS places
  FROM (SELECT id, n_mutations, {_PLACE} AS place FROM (SELECT id, n_mutations, unnest(range(1, n_mutations + 1)) AS k FROM (SELECT id, CAST({_N_MUT} AS INTEGER) AS n_mutations FROM (SELECT id, {u_sql(3, 5, 'nmut|m', 'id')} AS d FROM {{neighbours60}})))) GROUP BY id, n_mutations""")
def _(spark, sf):
    """Mutations of a gamete of zeros at 8,192 loci and the default rate: how many are drawn, and which bits are set."""
    zero = F.array_repeat(F.lit(0).cast("bigint"), LONG_LOCI // BITS)
    p = neighbours(spark, sf).select("id", *(zero.alias(c) for c in ("m1", "m2", "d1", "d2")))
    out = ge.offspring(p, LONG_LOCI // BITS, LONG_LOCI, 3, 5, breaks=0, rate=LONG_RATE)
    words = out.select("id", F.posexplode_outer("strand1").alias("b", "w")).where("w <> 0")  # outer: no filter is derived that would make the strands twice
    halves = (0xAAAAAAAA, 0xCCCCCCCC, 0xF0F0F0F0, 0xFF00FF00, 0xFFFF0000)  # where the 1st, 2nd, ... digit of a bit's place is set
    within = sum((F.bit_count(F.col("w").bitwiseAND(F.lit(h).cast("bigint"))) * (1 << k) for k, h in enumerate(halves)), F.lit(0))
    n = F.bit_count("w")
    found = words.groupBy("id").agg(F.sum(n.cast("bigint")).alias("n_set"), F.sum((F.col("b") * BITS * n + within).cast("bigint")).alias("places"))
    return found.select("id", ge.binomial_count(u(3, 5, "nmut|m", F.col("id")), LONG_LOCI, LONG_RATE).alias("n_mutations"), "n_set", "places")


@query("E7_initial_random", f"SELECT c_custkey AS id, {blocks_sql('k[{j}]')} AS strand FROM (SELECT c_custkey, {mask_sql('init', 'c_custkey')} AS k FROM customer)")
def _(spark, sf):
    ids = m.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return ids.select("id", key_of(ge.random_mask("init", F.col("id"), BLOCKS)).alias("strand"))


SITES = [(0.3, 2), (0.9, 31), (0.5, 32), (0.1, 95)]


def _hw_sql(s: int, i: int) -> str:
    terms = [f"(CASE WHEN {u_sql(9, 0, f'hw{s}|{site}', 'c_custkey')} < {rate}e0 THEN {1 << site % 32} ELSE 0 END)::BIGINT" for rate, site in SITES if site // 32 == i]
    return " | ".join(terms) or "0"


@query("E7a_hardy_weinberg", "SELECT c_custkey AS id, " + ", ".join("concat_ws('-', " + ", ".join(_hw_sql(s, i) for i in range(BLOCKS)) + f") AS strand{s}" for s in (1, 2)) + " FROM customer")
def _(spark, sf):
    ids = m.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    out = ge.hardy_weinberg(ids, SITES, BLOCKS, 9)
    return out.select("id", key_of("strand1").alias("strand1"), key_of("strand2").alias("strand2"))


cte("alleles", f"""SELECT CAST(l AS INTEGER) AS locus, CAST((s[l // 32 + 1] >> (l % 32)) & 1 AS INTEGER) AS code, count(*) AS n
  FROM (SELECT unnest([strand1, strand2]) AS s FROM {{genomes}}), range({LOCI}) t(l) GROUP BY 1, 2""")


def alleles(spark, sf):
    return ge.allele_counts(m.genomes(spark, sf), LOCI)


@query("G4_allele_counts", "SELECT locus, code, n FROM {alleles}")
def _(spark, sf):
    return alleles(spark, sf)


@query("G5_variability", "SELECT locus, count(DISTINCT code) AS n_codes, CAST(sum(CASE WHEN code <> 0 THEN n ELSE 0 END) AS BIGINT) AS non_zero FROM {alleles} GROUP BY locus")
def _(spark, sf):
    return ge.variability(alleles(spark, sf))


@query("G6_ordered_frequencies", f"SELECT CAST(rank AS INTEGER) AS rank, round(sum(n) / {LOCI}e0, 6) AS mean FROM (SELECT n, row_number() OVER (PARTITION BY locus ORDER BY n DESC, code) AS rank FROM {{alleles}}) GROUP BY rank")
def _(spark, sf):
    return ge.ordered_frequencies(alleles(spark, sf), LOCI).withColumn("mean", F.round("mean", 6))


@query("E7b_variation_score", "SELECT CAST(sum(c) AS BIGINT) AS score, max(c) AS top FROM (SELECT locus, count(DISTINCT code) AS c FROM {alleles} GROUP BY locus)")
def _(spark, sf):
    return ge.variability(alleles(spark, sf)).agg(F.sum("n_codes").alias("score"), F.max("n_codes").alias("top"))


_TEXT = "(SELECT string_agg(substr('AGCT', CAST((strand1[l // 16 + 1] >> (l % 16 * 2)) & 3 AS INTEGER) + 1, 1), '' ORDER BY l) FROM range(48) t(l))"
cte("texts", f"SELECT id, cell, {_TEXT} AS seq FROM {{genomes}}")


def texts(spark, sf):
    return m.genomes(spark, sf).select("id", "cell", g.to_text(F.col("strand1"), BITS, 48).alias("seq"))


@query("E8_nucleotide_text", "SELECT id, seq, true AS same FROM {texts}")
def _(spark, sf):
    x = m.genomes(spark, sf).withColumn("seq", g.to_text(F.col("strand1"), BITS, 48))
    return x.select("id", "seq", (g.from_text(F.col("seq"), BITS) == F.col("strand1")).alias("same"))


@query("E9_plink_interleave", f"""SELECT id, (SELECT string_agg(substr('AGCT', CAST((strand1[l // 16 + 1] >> (l % 16 * 2)) & 3 AS INTEGER) + 1, 1) || ' ' || substr('AGCT', CAST((strand2[l // 16 + 1] >> (l % 16 * 2)) & 3 AS INTEGER) + 1, 1), ' ' ORDER BY l) FROM range(48) t(l)) AS pairs FROM {{genomes}}""")
def _(spark, sf):
    a, b = (g.to_text(F.col(s), BITS, 48) for s in ("strand1", "strand2"))
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.concat_ws(" ", x, y))
    return m.genomes(spark, sf).select("id", F.array_join(pairs, " ").alias("pairs"))


_CODE = " + ".join(f"(instr('TCAG', substr(seq, CAST(i * 3 + {k + 1} AS INTEGER), 1)) - 1) * {4 ** (2 - k)}" for k in range(3))
cte("proteomes", f"""SELECT id, list_transform(regexp_extract_all(amino, 'M[^*]*'), lambda p: md5(p)) AS hashes FROM (
  SELECT id, array_to_string(list_transform(range(len(seq) // 3), lambda i: substr('{ge.CODONS}', CAST({_CODE} + 1 AS INTEGER), 1)), '') AS amino FROM {{texts}})""")


@query("E10_proteins", "SELECT id, array_to_string(hashes, ',') AS hashes FROM {proteomes}")
def _(spark, sf):
    return texts(spark, sf).select("id", F.array_join(ge.protein_hashes(F.col("seq")), ",").alias("hashes"))


@query("E11_proteome_matches", "SELECT x.id AS a, y.id AS b, count(*) AS n FROM (SELECT id, unnest(hashes) AS p FROM {proteomes} WHERE id % 2 = 0) x JOIN (SELECT id, unnest(hashes) AS p FROM {proteomes} WHERE id % 2 <> 0) y ON x.p = y.p GROUP BY 1, 2")
def _(spark, sf):
    """Digests of whole proteins, all even ids against all odd ones; matches multiply with duplicates."""
    x = texts(spark, sf).withColumn("hashes", ge.protein_hashes(F.col("seq")))
    return ge.shared_proteins(x.where("id % 2 = 0").withColumnRenamed("id", "a"), x.where("id % 2 <> 0").withColumnRenamed("id", "b"))


@query("E12_segment_distances", f"""SELECT id, CAST(seg AS INTEGER) AS seg, CAST(count(*) FILTER (WHERE (a1[l // 32 + 1] >> (l % 32)) & 1 <> (b1[l // 32 + 1] >> (l % 32)) & 1) AS INTEGER) AS d
  FROM {{neighbours60}}, range({LOCI}) t(l), (SELECT unnest(range(4)) AS seg) WHERE l // 24 = seg GROUP BY id, seg""")
def _(spark, sf):
    n = neighbours(spark, sf)
    return n.select("id", F.posexplode(ge.segment_distances(F.col("a1"), F.col("b1"), 4, LOCI)).alias("seg", "d"))


cte("phenes", "SELECT a.vec_id AS id, a.label, a.embedding AS p, b.embedding AS q FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")


def phenes(spark, sf):
    e = m.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("p")).join(e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("q")), "id")


@query("E13_phenome_mix", f"SELECT id, round(list_sum(list_transform(list_zip(p, q), lambda x: (x[1]::DOUBLE + x[2]::DOUBLE) / 2)), 5) AS mean_sum, round(list_sum(list_transform(CASE WHEN {u_sql(2, 2, 'sel', 'id')} < 0.5 THEN p ELSE q END, lambda x: x::DOUBLE)), 5) AS selected_sum FROM {{phenes}}")
def _(spark, sf):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double")), 5)
    x = phenes(spark, sf)
    return x.select("id", total(ge.mix_phenomes(F.col("p"), F.col("q"))).alias("mean_sum"), total(ge.mix_phenomes(F.col("p"), F.col("q"), u(2, 2, "sel", F.col("id")))).alias("selected_sum"))


@query("E14_phenome_distance", "SELECT id, round(sqrt(list_sum(list_transform(list_zip(p, q), lambda x: (x[1] - x[2])::DOUBLE * (x[1] - x[2])::DOUBLE))), 5) AS dist FROM {phenes}")
def _(spark, sf):
    return phenes(spark, sf).select("id", F.round(ge.phenome_distance(F.col("p"), F.col("q")), 5).alias("dist"))


_NUDGE = f"0.5e0 * sqrt(-2e0 * ln(1e0 - {u_sql(2, 2, 'nudge', 'id', 'i')})) * cos({2 * math.pi!r}::DOUBLE * {u_sql(2, 2, 'turn', 'id', 'i')})"


@query("E13_phenome_mutation", f"SELECT id, round(sum(x), 5) AS total, round(max(x), 5) AS top FROM (SELECT id, p[i + 1]::DOUBLE + {_NUDGE} AS x FROM (SELECT id, p, unnest(range(len(p))) AS i FROM {{phenes}})) GROUP BY id")
def _(spark, sf):
    """Every trait is nudged by a normal draw."""
    x = phenes(spark, sf).select("id", ge.mutate_phenome(F.col("p"), 0.5, 2, 2, F.col("id")).alias("p"))
    return x.select("id", F.round(F.aggregate("p", F.lit(0.0), lambda s, v: s + v), 5).alias("total"), F.round(F.array_max("p"), 5).alias("top"))


@query("E14_mean_strand_distance", """SELECT a.id, round(sqrt(list_sum(list_transform(list_zip(a.p, a.q, b.p, b.q), lambda x: ((x[1]::DOUBLE + x[2] - x[3] - x[4]) / 2) ** 2))), 5) AS dist FROM {phenes} a JOIN {phenes} b ON b.id = a.id + 2""")
def _(spark, sf):
    """Two phenomes of two strands each, averaged before they are compared."""
    a = phenes(spark, sf).select("id", F.col("p").alias("a1"), F.col("q").alias("a2"))
    b = phenes(spark, sf).select((F.col("id") - 2).alias("id"), F.col("p").alias("b1"), F.col("q").alias("b2"))
    return a.join(b, "id").select("id", F.round(ge.mean_strand_distance(*map(F.col, ("a1", "a2", "b1", "b2"))), 5).alias("dist"))


@query("E15_sequence_extraction", "SELECT id, seq FROM {texts} WHERE id IN (SELECT s_suppkey * 3 FROM supplier)")
def _(spark, sf):
    wanted = m.table(spark, sf, "supplier").select((F.col("s_suppkey") * 3).alias("id"))
    return texts(spark, sf).join(wanted, "id", "left_semi").select("id", "seq")


@query("E16_geo_ordered_distances", "SELECT row_number() OVER (ORDER BY x.cell, x.id, y.cell, y.id) AS r, a, b, dist FROM {sample_dist} JOIN {genomes} x ON x.id = a JOIN {genomes} y ON y.id = b")
def _(spark, sf):
    """Pairs in the order of both genomes' cells and ids; their numbers follow from the genomes' own, so pairs are not sorted."""
    order = [F.asc_nulls_last("cell"), "id"]
    placed = numbered(m.genomes(spark, sf).where("id is not null"), order, "place")
    sample = numbered(placed.where("id % 50 = 0"), order, "nth")
    return numbered_distance_pairs(sample, placed, placed.count())


def all_distance_sums(spark, sf):
    """Sums of ``distances``, by sampled genome: the pairs are not written out."""
    genomes = m.genomes(spark, sf)
    return distance_sums(genomes.where("id % 50 = 0"), genomes)


@query("G8_distance_summary", "SELECT min(dist) AS low, max(dist) AS high, round(avg(dist), 6) AS mean, (min({'d': dist, 'a': a, 'b': b})).a AS low_a, (min({'d': dist, 'a': a, 'b': b})).b AS low_b FROM {sample_dist}")
def _(spark, sf):
    least = F.min(F.struct("low", "a", "low_b"))
    d = all_distance_sums(spark, sf).agg(F.min("low").alias("low"), F.max("high").alias("high"), (F.sum("total") / F.sum("n")).alias("mean"), least.alias("at"))
    return d.select("low", "high", F.round("mean", 6).alias("mean"), F.col("at.a").alias("low_a"), F.col("at.low_b").alias("low_b"))


@query("G9_lattice_means", "SELECT round(c.lon / 15) * 15 AS glon, round(c.lat / 15) * 15 AS glat, round(avg(dist), 6) AS mean, count(*) AS n FROM {sample_dist} JOIN {genomes} x ON x.id = a JOIN {cells} c ON c.cell = x.cell GROUP BY 1, 2")
def _(spark, sf):
    at = m.genomes(spark, sf).join(m.cells(spark, sf), "cell").select(F.col("id").alias("a"), (F.round(F.col("lon") / 15) * 15).alias("glon"), (F.round(F.col("lat") / 15) * 15).alias("glat"))
    return all_distance_sums(spark, sf).join(at, "a").groupBy("glon", "glat").agg(F.round(F.sum("total") / F.sum("n"), 6).alias("mean"), F.sum("n").alias("n"))


LANDMARKS = 64


def landmark_distances(spark, sf):
    """``id, landmark, dist``: all genomes against the landmarks (those of least draw, at most ``LANDMARKS``)."""
    g = m.genomes(spark, sf)
    chosen = g.orderBy(u(17, 0, "landmark", F.col("id")), "id").limit(LANDMARKS)
    a = chosen.select(F.col("id").alias("landmark"), F.col("strand1").alias("a1"), F.col("strand2").alias("a2"))
    b = g.select("id", F.col("strand1").alias("b1"), F.col("strand2").alias("b2"))
    both = against_all(a, b, "landmark", LANDMARKS)
    return both.select("id", "landmark", diploid_distance(F.col("a1"), F.col("a2"), F.col("b1"), F.col("b2")).alias("dist"))


@query("E17_pco")
def _(spark, sf):
    """Every genome in the first three principal coordinates of the landmarks."""
    return ge.principal_coordinates(cut(landmark_distances(spark, sf)), 3, LANDMARKS)


@query("E18_pca")
def _(spark, sf):
    """Principal components of phenomes (signs are arbitrary, so lengths are returned)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = m.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    found = PCA(k=3, inputCol="v", outputCol="c").fit(rows).transform(rows)
    return found.select("id", F.transform(vector_to_array("c"), lambda x: F.round(F.abs(x), 6)).alias("components"))
