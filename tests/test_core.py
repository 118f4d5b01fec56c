"""Operators against their definitions: one-to-one pairs, greedy rules, graphs, parsers, schedules, streams."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cohortspark.functions import genome as g
from cohortspark.functions import draws, projections
from cohortspark.operators import ancestry, evaluators, genetics, grid, moving, pairing, raster, rates, regions
from cohortspark.operators.components import connected_components
from cohortspark.plans import model as m
from cohortspark.plans import simulate as s
from cohortspark.queries import ORACLE_SQL, QUERIES
from cohortspark.sources import config, text
from cohortspark.streaming import population_stream, triggers

SF = "/root/testdata/sf0.001"


def test_components_by_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 90)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[find(a)] = find(b)
    least = {}
    for x in list(parent):
        least[find(x)] = min(least.get(find(x), x), x)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {x: least[find(x)] for x in parent}
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_pairs_are_one_to_one_and_complete(spark):
    agents = m.agents(spark, SF)
    able = agents.where("life_state = 5").groupBy("cell", "gender").count().collect()
    by_cell = defaultdict(lambda: [0, 0])
    for r in able:
        by_cell[r.cell][r.gender] = r["count"]
    for op in (pairing.random_pairs, pairing.permuted_pairs):
        pairs = op(agents, 1, 2).collect()
        assert len({p.female for p in pairs}) == len({p.male for p in pairs}) == len(pairs)
        assert Counter(p.cell for p in pairs) == {c: min(v) for c, v in by_cell.items() if min(v)}


@pytest.mark.parametrize("name", ["J7_sel_pair", "J8_assortative_pair", "J9_assortative_pair_ham", "J10_rank_table_pairs"])
def test_sequential_pairs_are_one_to_one(spark, name):
    pairs = QUERIES[name](spark, SF).collect()
    assert pairs and len({p.female for p in pairs}) == len({p.male for p in pairs}) == len(pairs)
    assert set(pairs) == set(QUERIES[name](spark, SF).collect())


def draw(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0


def brute_greedy(rows, cutoff, seed, step):
    """The largest score in turn; its females in random order each take a random male of that score."""
    left, out = [r for r in rows if r[3] >= cutoff], set()
    while left:
        top = max(r[3] for r in left)
        female = min({r[1] for r in left if r[3] == top}, key=lambda f: (draw(seed, step, "greedy", f), f))
        male = min((r[2] for r in left if r[3] == top and r[1] == female), key=lambda m: (draw(seed, step, "choose", female, m), m))
        out.add((female, male))
        left = [r for r in left if r[1] != female and r[2] != male]
    return out


def test_greedy_takes_the_best_first(spark):
    schema = "cell int, female long, male long, score double"
    rows = [(1, 1, 10, 5.0), (1, 1, 11, 9.0), (1, 2, 11, 8.0), (1, 2, 10, 1.0), (1, 3, 10, 4.0), (1, 3, 12, 0.1)]
    got = pairing.greedy_pairs(spark.createDataFrame(rows, schema), 1.0, 1, 1)
    assert {(r.female, r.male) for r in got.collect()} == {(1, 11), (3, 10)}
    rng = random.Random(6)
    for seed in range(3):
        rows = [(c, 100 * c + f, 1000 * c + m_, float(rng.randrange(6))) for c in range(4) for f in range(9) for m_ in range(7) if rng.random() < 0.8]
        got = pairing.greedy_pairs(spark.createDataFrame(rows, schema), 1.0, seed, 2)
        assert {(r.female, r.male) for r in got.collect()} == brute_greedy(rows, 1.0, seed, 2)


def test_rates_at_the_edges(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(rates.birth_rate(0.2, 0.1, F.lit(5), F.lit(0.0))) == 0 and value(rates.death_rate(0.2, 0.1, F.lit(5), F.lit(-1.0))) == 1
    assert value(rates.birth_rate(0.2, 0.1, F.lit(300), F.lit(100.0))) < 0
    assert value(rates.death_rate(0.1, 0.4, F.lit(100), F.lit(100.0))) == pytest.approx(0.4)


def test_moves_with_missing_neighbours_and_no_weight(spark):
    cells = spark.createDataFrame([(0, 0, 0), (1, 1, 0)], "cell int, x int, y int")
    edges = grid.lattice_edges(cells, 2, 1, periodic=False)
    env = spark.createDataFrame([(0, False, 0.0), (1, True, 0.0)], "cell int, ice boolean, w double")
    agents = spark.range(200).select("id", (F.col("id") % 2).cast("int").alias("cell"), F.lit(5).alias("life_state"))
    out = moving.random_move(agents, edges, 1.0, 1, 1).collect()
    assert all(r.target == 1 - r.cell for r in out)
    lost = moving.random_move(agents, edges, 1.0, 1, 1, absorbing=True).collect()
    assert all(r.is_dead or r.target == 1 - r.cell for r in lost) and any(r.is_dead for r in lost)
    cum = evaluators.single_evaluator(edges, env, "w", [(0.0, 0.0), (1.0, 1.0)])
    stay = moving.weighted_move(agents, cum, env, 1.0, 1, 1, uniform_if_zero=True).collect()
    assert all(r.target in (None, 1 - r.cell) for r in stay) and all(r.target is None for r in stay if r.cell == 1)
    assert len(grid.draw_from(cum, agents.select("id", "cell", F.lit(0.5).alias("r"))).where("k = -1").collect()) == 200


def test_genome_identities(spark):
    top = (1 << 63) - 1
    rows = [([0, 5], [7, 9], [7, 9], [0, 5]), ([top, -1], [0, 0], [top, -1], [0, 0])]
    df = spark.createDataFrame(rows, "a1 array<long>, a2 array<long>, b1 array<long>, b2 array<long>")
    got = df.select(g.diploid_distance(*map(F.col, ("a1", "a2", "b1", "b2"))).alias("d"), g.popcount_distance(F.col("a1"), F.col("a2")).alias("s")).collect()
    assert [r.d for r in got] == [0, 0] and got[1].s == 63 + 64


def test_crossover_and_mutation_by_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        rows.append((i, [rng.getrandbits(32) for _ in range(3)], [rng.getrandbits(32) for _ in range(3)], [rng.randrange(96) for _ in range(rng.randint(1, 4))]))
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>, p array<long>")
    got = {r.i: r for r in df.select("i", g.crossover(F.col("a"), F.col("b"), F.col("p"), 32).alias("x"), g.mutate(F.col("a"), F.col("p"), 32, 3).alias("m")).collect()}
    bit = lambda s, i: s[i // 32] >> (i % 32) & 1
    for i, a, b, p in rows:
        for k in range(96):
            assert bit(got[i].x, k) == bit(b if sum(q <= k for q in p) % 2 else a, k)
            assert bit(got[i].m, k) == (bit(a, k) | (k in p))


def slow_proteins(text):
    order, out, current = {c: i for i, c in enumerate("TCAG")}, [], None
    for i in range(0, len(text) - 2, 3):
        amino = genetics.CODONS[order[text[i]] * 16 + order[text[i + 1]] * 4 + order[text[i + 2]]]
        if current is None:
            current = "M" if amino == "M" else None
        elif amino == "*":
            out, current = [*out, current], None
        else:
            current += amino
    return [*out, current] if current else out


def test_proteins(spark):
    rng = random.Random(4)
    texts = ["ATGTTTTAAATGCCC", "AAAAAA", "", "AT", "ATG", "ATGATGTAATGA", *("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 90))) for _ in range(60))]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", genetics.proteins(F.col("t")).alias("p")).collect()
    assert {r.i: r.p for r in got} == {i: slow_proteins(t) for i, t in enumerate(texts)} and len(genetics.CODONS) == 64


def test_binomial_tables_have_no_cap(spark):
    for n, rate in ((8192, 0.01), (96, 0.02), (50, 0.5), (100_000, 0.3), (7, 1.0), (7, 0.0)):
        low, table = genetics.binomial_table(n, rate)
        assert all(a < b for a, b in zip(table, table[1:], strict=False)) and low + len(table) <= n + (rate == 0)
        if table:
            assert table[0] >= 2**-33 and table[-1] < 1 - 2**-33
            mean = sum(1 - t for t in table) + low
            assert mean == pytest.approx(n * rate, rel=1e-6)
    seen = spark.range(3000).select(genetics.binomial_count(draws.u(1, 1, "n", F.col("id")), 8192, 0.01).alias("n")).agg(F.avg("n"), F.max("n")).first()
    assert abs(seen[0] - 81.92) < 1 and seen[1] > 100


def brute_evolve(nodes, founders, blocks, seed):
    known = dict(founders)
    for i, mom, dad in sorted(nodes):
        if mom in known and dad in known and i not in known:
            strands = []
            for parent, tag in ((mom, "mom"), (dad, "dad")):
                digest = hashlib.md5(f"{seed}|evolve|{tag}|{i}".encode()).hexdigest()
                masks = [int(digest[8 * b : 8 * b + 8], 16) for b in range(blocks)]
                strands.append([x & k | y & ~k & 0xFFFFFFFF for x, y, k in zip(*known[parent], masks, strict=True)])
            known[i] = tuple(strands)
    return known


def test_evolving_a_graph(spark):
    rng = random.Random(12)
    nodes = [(i, 0, 0) if i < 6 else (i, rng.randrange(max(0, i - 9), i) or 1, rng.randrange(max(0, i - 9), i) or 2) for i in range(1, 120)]
    nodes += [(500, 999, 3), (501, 500, 4)]  # wait for a parent that never comes
    founders = {i: tuple([rng.getrandbits(32) for _ in range(2)] for _ in range(2)) for i in range(1, 6) if i != 5}
    a = spark.createDataFrame(nodes, "id long, mom long, dad long")
    f = spark.createDataFrame([(i, *g_) for i, g_ in founders.items()], "id long, strand1 array<long>, strand2 array<long>")
    got = {r.id: (r.strand1, r.strand2) for r in ancestry.evolve(a, f, 2, 1).collect()}
    want = brute_evolve(nodes, founders, 2, 1)
    # A node may have all its bits from founders that are known although another line of it is not: it counts as known.
    assert set(want) <= set(got) and all(got[i] == tuple(want[i]) for i in want)
    assert 500 not in got and 501 not in got


def evolved_bits(nodes, founders, blocks, seed):
    """Values of all nodes with every bit known, by passes until nothing changes (in any order of ids, with circles)."""
    full = 0xFFFFFFFF
    state = {i: [[(v & full, full) if v is not None else (0, 0) for v in s] for s in strands] for i, strands in founders.items()}
    masks = {(i, tag): [int(hashlib.md5(f"{seed}|evolve|{tag}|{i}".encode()).hexdigest()[8 * b : 8 * b + 8], 16) for b in range(blocks)] for i, _, _ in nodes for tag in ("mom", "dad")}
    none, changed = [[(0, 0)] * blocks] * 2, True
    while changed:
        changed = False
        for i, mom, dad in nodes:
            if mom > 0 and i not in founders:
                mix = lambda x, y, m: tuple(a & m | b & ~m & full for a, b in zip(x, y, strict=True))
                new = [[mix(x, y, m) for x, y, m in zip(*state.get(p, none), masks[i, tag], strict=True)] for p, tag in ((mom, "mom"), (dad, "dad"))]
                changed, state[i] = changed or state.get(i, none) != new, new
    return {i: tuple([v for v, _ in s] for s in strands) for i, strands in state.items() if i not in founders and all(k == full for s in strands for _, k in s)}


@pytest.mark.parametrize("turned", [False, True])
def test_evolving_in_pieces(spark, turned):
    rng = random.Random(5)
    nodes = [(i, rng.randrange(i - 3, i), rng.randrange(i - 3, i)) for i in range(7, 420)]
    nodes += [(500, 500, 6), (501, 502, 6), (502, 501, 6), (503, 502, 419), (504, 9999, 6), (505, 419, None), (506, 419, 505), (507, 419, 418), (507, 419, 418)]
    turn = (lambda i: i if i is None else 10_000 - i) if turned else (lambda i: i)
    nodes = [tuple(map(turn, n)) for n in nodes]
    founders = {turn(i): tuple([rng.getrandbits(32) for _ in range(3)] for _ in range(2)) for i in (*range(1, 7), 200)}
    founders[turn(3)] = ([1, None, 5], [7, 8, 9])
    a = spark.createDataFrame(nodes, "id long, mom long, dad long")
    f = spark.createDataFrame([(i, *g_) for i, g_ in founders.items()], "id long, strand1 array<long>, strand2 array<long>")
    want = evolved_bits(nodes, founders, 3, 1)
    assert turn(507) in want and turn(505) not in want and 100 < len(want) < 414  # founder 3 lacks a block
    for size in (16, 10_000):
        got = [r for r in ancestry.evolve(a, f, 3, 1, size=size).collect() if r.id not in founders]
        assert {r.id: (r.strand1, r.strand2) for r in got} == want and len(got) == len(want)


def test_evolving_without_order_of_ids(spark):
    rng = random.Random(6)
    name = dict(zip(range(1, 121), rng.sample(range(1, 10_000), 120), strict=True))
    nodes = [(name[i], name[rng.randrange(1, i)], name[rng.randrange(1, i)]) for i in range(5, 121)]
    founders = {name[i]: tuple([rng.getrandbits(32)] for _ in range(2)) for i in range(1, 5)}
    a = spark.createDataFrame(nodes, "id long, mom long, dad long")
    f = spark.createDataFrame([(i, *g_) for i, g_ in founders.items()], "id long, strand1 array<long>, strand2 array<long>")
    got = {r.id: (r.strand1, r.strand2) for r in ancestry.evolve(a, f, 1, 1, size=16).collect() if r.id not in founders}
    assert got == evolved_bits(nodes, founders, 1, 1) and len(got) == 116


def folder_bytes(spark):
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


def test_evolving_keeps_little_on_disk(spark):
    sf = SF.replace("0.001", "0.01")
    from cohortspark.functions.lineage import cut

    cut(spark.range(1))
    before = folder_bytes(spark)
    assert QUERIES["N6_evolve_graph"](spark, sf).count() == 15_000
    assert folder_bytes(spark) - before < 2_000_000


def test_sampling_and_evolving_keeps_little_on_disk(spark):
    from cohortspark.functions.lineage import cut

    cut(spark.range(1))
    before = folder_bytes(spark)
    assert QUERIES["N9_sampled_genomes"](spark, SF.replace("0.001", "0.01")).count() == 300
    assert folder_bytes(spark) - before < 1_000_000


def test_samples_in_pieces(spark):
    rng = random.Random(9)
    nodes = [(i, rng.randrange(i - 3, i), rng.randrange(i - 3, i)) for i in range(5, 300)] + [(400, 999, 5)]
    founders = {i: tuple([rng.getrandbits(32)] for _ in range(2)) for i in range(1, 5)}
    a = spark.createDataFrame(nodes + [(i, 0, 0) for i in range(1, 5)], "id long, mom long, dad long")
    f = spark.createDataFrame([(i, *g_) for i, g_ in founders.items()], "id long, strand1 array<long>, strand2 array<long>")
    want = evolved_bits(nodes, founders, 1, 1) | founders
    samples = [2, 3, 77, 77, 78, 299, 400, 5000]  # founders, a sample named twice, one without genome, one that is no node
    for size in (16, 10_000):
        rows = ancestry.evolve(a, f, 1, 1, spark.createDataFrame([(i,) for i in samples], "id long"), size).collect()
        assert sorted(r.id for r in rows) == [2, 3, 77, 78, 299] and all((r.strand1, r.strand2) == tuple(want[r.id]) for r in rows)


def test_sampled_genomes_are_those_of_the_whole_graph(spark):
    whole = {r.id: (r.strand1, r.strand2) for r in QUERIES["N6_evolve_graph"](spark, SF).collect()}
    got = {r.id: (r.strand1, r.strand2) for r in QUERIES["N9_sampled_genomes"](spark, SF).collect()}
    assert got == {i: g_ for i, g_ in whole.items() if i % 50 == 0} and got


def test_deep_graphs_have_no_cap(spark):
    chain = spark.range(1, 700).select("id", (F.col("id") - 1).alias("mom"), (F.col("id") - 1).alias("dad"))
    founders = spark.createDataFrame([(1, [5], [5])], "id long, strand1 array<long>, strand2 array<long>")
    got = ancestry.evolve(chain.where("id > 1").unionByName(spark.createDataFrame([(1, 0, 0)], "id long, mom long, dad long")), founders, 1, 1)
    assert got.where("strand1 = array(5L) and strand2 = array(5L)").count() == 699
    short = chain.where("id < 40")
    reach = ancestry.back_reach(short, spark.createDataFrame([(39, 39)], "origin long, id long")).collect()
    assert {r.id: r.depth for r in reach} == {i: 39 - i for i in range(1, 40)}


def test_rows_are_numbered_in_order(spark):
    from cohortspark.operators.ordering import against_all, numbered

    rng = random.Random(1)
    rows = [(i, rng.choice("abc")) for i in range(1000)]
    got = numbered(spark.createDataFrame(rows, "i int, k string").repartition(9), ["k", "i"]).collect()
    assert [(r.k, r.i) for r in sorted(got, key=lambda r: r.r)] == sorted((k, i) for i, k in rows) and {r.r for r in got} == set(range(1, 1001))
    assert numbered(spark.createDataFrame([], "i int"), ["i"]).count() == 0
    both = against_all(spark.range(0, 500, 50).withColumnRenamed("id", "a"), spark.range(500).withColumnRenamed("id", "b"), "a", block=3, salts=4).collect()
    assert sorted((r.a, r.b) for r in both) == [(a, b) for a in range(0, 500, 50) for b in range(500)]
    assert against_all(spark.range(0).withColumnRenamed("id", "a"), spark.range(5).withColumnRenamed("id", "b"), "a").count() == 0


def test_running_sums_and_ranks(spark):
    from cohortspark.operators.ordering import ranked, running_sums

    rng = random.Random(3)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(50)) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, k string, v long").repartition(7)
    total, want = 0, {}
    for i, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        total += v
        want[i] = total
    assert {r.i: r.upto for r in running_sums(df, ["v", "i"], {"v": "upto"}).collect()} == want
    got = {r.i: r.n for r in ranked(df.where("k is not null"), ["k"], ["v", "i"], "n").collect()}
    for k in ("hot", "a"):
        own = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))
        assert all(got[r[0]] == n + 1 for n, r in enumerate(own))


def test_nearest_places(spark):
    from cohortspark.operators import spatial

    rng = random.Random(8)
    at = lambda n: [(i, rng.uniform(-180, 180), rng.uniform(-89, 89)) for i in range(n)]
    points, places = at(60), at(9)
    got = {r.id: (r.cell, r.d) for r in spatial.nearest(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(places, "cell long, lon double, lat double"), "id", "cell", 50.0).collect()}
    rad = math.radians

    def dist(a, b):
        c = math.sin(rad(a[2])) * math.sin(rad(b[2])) + math.cos(rad(a[2])) * math.cos(rad(b[2])) * math.cos(rad(a[1] - b[1]))
        return 6371.3 * math.acos(max(-1, min(1, c)))

    assert got == {p[0]: (best := min(places, key=lambda q: dist(p, q)))[0:1] + (pytest.approx(dist(p, best), abs=1e-3),) for p in points}


def test_coalescence_without_common_ancestor(spark):
    a = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 0, 0), (3, 1, 1, 4), (4, 2, 2, 5), (5, 3, 1, 6)], "id long, mom long, dad long, time int")
    got = {(r.a, r.b): r.time for r in ancestry.coalescence(a, spark.createDataFrame([(3,), (4,), (5,)], "id long")).collect()}
    assert got == {(3, 4): None, (3, 5): 4, (4, 5): None}


@pytest.mark.parametrize("mode", ["smallest", "largest", "random", "all"])
def test_regions_cover_and_sum(spark, mode):
    counts = spark.createDataFrame([(i, i % 4 + 1) for i in range(25)], "cell int, n long")
    cells = spark.createDataFrame([(i, i % 5, i // 5) for i in range(25)], "cell int, x int, y int")
    got = regions.grow_regions(grid.lattice_edges(cells, 5, 5, periodic=False), counts, 4, mode).collect()
    assert len(got) == 25 and len({r.region for r in got}) <= 4
    for region in {r.region for r in got}:
        own = [r for r in got if r.region == region]
        assert own[0].n == sum(r.cell % 4 + 1 for r in own) and region == min(r.cell for r in own)


def test_principal_coordinates(spark):
    rng = random.Random(5)
    points = {i: (rng.uniform(-9, 9), rng.uniform(-3, 3)) for i in range(30)}
    rows = [(a, b, math.dist(points[a], points[b])) for a in points for b in list(points)[::3]]
    got = genetics.principal_coordinates(spark.createDataFrame(rows, "id long, landmark long, dist double"), 3).collect()
    assert {r.axis for r in got} == {0, 1} and len(got) == 60  # two dimensions, all rows
    at = {i: [r.value for r in sorted(got, key=lambda r: r.axis) if r.id == i] for i in points}
    assert all(math.dist(at[a], at[b]) == pytest.approx(math.dist(points[a], points[b]), abs=1e-6) for a in points for b in points)
    values = sorted({r.eigenvalue for r in got}, reverse=True)
    assert values == sorted({r.eigenvalue for r in got if r.axis == 0}) + sorted({r.eigenvalue for r in got if r.axis == 1})
    with pytest.raises(ValueError):
        genetics.principal_coordinates(spark.createDataFrame(rows, "id long, landmark long, dist double"), 3, landmarks=5)


@pytest.mark.parametrize("name", projections.NAMES)
def test_projections_at_their_centre(spark, name):
    p = projections.Projection(name, 0.2, 0.4, 0.3, 0.6)
    x, y = p.forward(F.lit(0.2), F.lit(0.4))
    lon, lat = p.inverse(x, y)
    got = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert got.lon == pytest.approx(0.2, abs=1e-6) and got.lat == pytest.approx(0.4, abs=1e-6)


def test_trigger_grammar():
    T = triggers.Trigger
    assert triggers.parse_triggers("5", 30) == ([T(0, math.inf, 5)], False)
    assert triggers.parse_triggers("-20", 50)[0][0].first == 10 or triggers.parse_triggers("-20", 50)[0][0].first == -10
    assert triggers.parse_triggers("[3]", 30) == ([T(3, 3, 1)], False)
    assert triggers.parse_triggers("[:10]2", 30) == ([T(0, 10, 2)], False)
    assert triggers.parse_triggers("[4:]", 30) == ([T(4, math.inf, 1)], False)
    assert triggers.parse_triggers("[-3:]", 30) == ([T(27, math.inf, 1)], False)
    assert triggers.parse_triggers("[1]+[7]+final", 30) == ([T(1, 1, 1), T(7, 7, 1)], True)
    with pytest.raises(ValueError):
        triggers.parse_triggers("x", 30)


def test_definitions():
    pop = config.parse_population(
        "CLASS WavePop\nSPECIES 104 sapiens # name\nSENSING 2\nBEGIN_PARAMS\nVerhulst_b0 = 0.2\nAltPref = -1 0 0 1 2000 0.5\nPRIO Verhulst 2\nPRIO Move 1\nPRIO GetOld 2\nEND_PARAMS\n"
    )
    assert (pop.class_name, pop.species, pop.species_id, pop.sensing) == ("WavePop", "sapiens", 104, 2)
    assert pop.polyline("AltPref") == [(-1, 0), (0, 1), (2000, 0.5)] and pop.actions() == [(1, ["Move"]), (2, ["Verhulst", "GetOld"])]
    with pytest.raises(ValueError):
        config.parse_population("what is this")
    assert config.parse_event("env|geo+climate:w.qdf@[100]") == {"kind": "env", "what": "geo+climate", "file": "w.qdf", "when": "[100]"}
    assert config.parse_grid("type rect\nwidth = 500 # cells") == {"type": "rect", "width": "500"}


def test_agent_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# lon lat: life id\n1.5 -2 : 1 7\n\nbad line\n3 4: 1\n")
    got = sorted(map(tuple, text.read_agents(spark, str(tmp_path), ["life", "id"]).collect()), key=repr)
    assert got == sorted([(1.5, -2.0, 1.0, 7.0, False), (None, None, None, None, True), (3.0, 4.0, 1.0, None, True)], key=repr)
    assert text.wildcard_regex("a*?#.x") == r"^a(.*)(.)([0-9]+)\.x$"


def test_simulation_invariants(spark):
    agents = m.agents(spark, SF).where("life_state > 0").select("id", "cell", "life_state", "gender", "birth_time", "last_birth")
    before = agents.count()
    sim = s.Simulation({"a": agents}, {}, m.edges(spark, SF), m.env(spark, SF))
    seen = []
    sim.add_action("a", s.get_old(1))
    sim.add_action("a", s.fertility(15, 50, 5, 2))
    sim.add_action("a", s.random_pair(3))
    sim.add_action("a", s.verhulst(0.3, 0.1, 0.15, 12.0, 4))
    sim.add_action("a", s.old_age_death(45, 0.1, 5))
    sim.add_action("a", s.Action("Count", lambda sm, a, _: (seen.append(a.agg(F.sum("n_births"), F.count_if("is_dead")).first()), a)[1], priority=6))
    sim.add_action("a", s.random_move(0.5, priority=7))
    ended = []
    sim.at_end.append(lambda sm: ended.append(sm.step_no))
    sim.run(2)
    now = sim.populations["a"]
    assert now.count() == before + sum(b for b, _ in seen) - sum(d for _, d in seen) and ended == [2]
    assert now.select("id").distinct().count() == now.count()
    assert sim.remove_action("a", "GetOld") and not sim.remove_action("a", "GetOld")


def test_stream_matches_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "event_type", "value")
    events.where("event_id % 2 = 0").write.parquet(str(tmp_path / "in"))
    events.where("event_id % 2 = 1").write.mode("append").parquet(str(tmp_path / "in"))
    stream = population_stream.windowed_counts(population_stream.event_stream(spark, str(tmp_path / "in"), events.schema), "ts", "event_type")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    want = {(r.window_start, r.kind): r.n for r in population_stream.windowed_counts(events, "ts", "event_type").collect()}
    assert {(r.window_start, r.kind): r.n for r in spark.sql("select * from counted").collect()} == want


def test_registry():
    assert set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) > 150


def test_geodesic_grid():
    from cohortspark.operators.geodesic import geodesic

    for parts in (1, 2, 5):
        places, links = geodesic(parts)
        degree = Counter(links.ravel().tolist())
        assert len(places) == 10 * parts**2 + 2 and len(links) == 30 * parts**2
        assert Counter(degree.values()) == ({5: 12, 6: len(places) - 12} if parts > 1 else {5: 12})


def test_lineage_cuts(spark):
    from cohortspark.functions.lineage import cut, cut_to_table

    df = spark.range(100).withColumn("r", F.rand())
    fixed = cut(df)
    assert fixed.exceptAll(fixed).isEmpty() and "Range" not in fixed._jdf.queryExecution().toString()
    table, drop = cut_to_table(df)
    assert table.count() == 100 and table.exceptAll(table).isEmpty()
    drop()
    with pytest.raises(Exception):
        spark.read.parquet(table.inputFiles()[0]).count()


def test_asof_against_a_scan(spark):
    from datetime import datetime, timedelta

    from cohortspark.operators.asof import asof

    rng, start = random.Random(2), datetime(2020, 1, 1)
    left = [(i, start + timedelta(seconds=rng.randrange(5000))) for i in range(300)]
    right = [(start + timedelta(seconds=rng.randrange(500, 4000)), rng.choice([None, 1.0, 2.0]), i) for i in range(40)]
    got = {r.i: r.v for r in asof(spark.createDataFrame(left, "i int, t timestamp"), spark.createDataFrame(right, "t timestamp, v double, n int"), "t", "v", "n", ranges=7).collect()}
    for i, t in left:
        before = [(rt, n, v) for rt, v, n in right if rt <= t]
        assert got[i] == (max(before, key=lambda x: x[:2])[2] if before else None)


def test_evolving_the_whole_graph(spark):
    nodes = [(r.id, r.mom, r.dad) for r in m.ancestors(spark, SF).collect()]
    top = {i for i, mom, _ in nodes if mom == 0}
    founders = {r.id: (r.strand1, r.strand2) for r in m.genomes(spark, SF).collect() if r.id in top}
    want = brute_evolve([n for n in nodes if n[1]], founders, 3, 11)
    got = {r.id: (r.strand1, r.strand2) for r in QUERIES["N6_evolve_graph"](spark, SF).collect()}
    assert max(want) > 300 and all(got[i] == tuple(want[i]) for i in want) and set(want) <= set(got)


def test_biomes_far_from_single_bins(spark):
    rng = random.Random(2)
    rows = [(-30, 0, [2]), (45, 8, [5]), (46, 8, [5]), *((i, j, [2, 3, 5] if rng.random() < 0.5 else [3, 5]) for i in range(-20, 20) for j in range(9)), (0, 20, [8, 9]), (1, 20, [3]), (-1, 20, [5])]
    got = {(r.tb, r.rb): r.biome for r in raster.uniquify(spark.createDataFrame(rows, "tb long, rb long, biomes array<int>")).collect()}
    assert len(got) == len(rows)
    for t, r, own in rows:
        want = own[0]
        if len(own) > 1:
            rings = sorted((max(abs(t - x), abs(r - y)), b[0]) for x, y, b in rows if len(b) == 1 and b[0] in own)
            for upto in sorted({d for d, _ in rings}):
                sums = Counter(b for d, b in rings if d <= upto).most_common()
                if len(sums) == 1 or sums[0][1] > sums[1][1]:
                    want = sums[0][0]
                    break
        assert got[t, r] == want


@pytest.mark.parametrize("name", ["R20_apply_biomes", "R14_nearest", "R14_bilinear", "R14_bicubic", "J20_node_stats", "E8_nucleotide_text"])
def test_a_row_for_every_customer(spark, name):
    rows = QUERIES[name](spark, SF.replace("0.001", "0.01")).collect()
    assert len({r.id for r in rows}) == len(rows) == 1500
    assert name[:3] != "R20" or all(r.biome >= 0 for r in rows)  # every climate is in the table


def test_principal_components_of_phenomes(spark):
    import numpy as np

    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], float)
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = np.abs(x @ axes[:3].T)
    got = {r.id: r.components for r in QUERIES["E18_pca"](spark, SF).collect()}
    assert set(got) == set(ids) and np.allclose([got[i] for i in ids], want, atol=1e-4)


def test_packed_distances_match_brute_force(spark, monkeypatch):
    """Several chunks and blocks, repeated and missing ids; sums and numbers follow from the same pairs."""
    from cohortspark.operators import genome_pairs as gp

    monkeypatch.setattr(gp, "CHUNK", 7)
    monkeypatch.setattr(gp, "BLOCK", 3)
    draw = random.Random(5)
    strand = lambda: [draw.getrandbits(32) for _ in range(3)]
    data = [(i, strand(), strand()) for i in [*range(40), 4, 11, None]]
    rows = spark.createDataFrame(data, "id long, strand1 array<long>, strand2 array<long>")
    bits = lambda x, y: sum((p ^ q).bit_count() for p, q in zip(x, y, strict=True))
    dist = lambda x, y: min(bits(x[1], y[1]) + bits(x[2], y[2]), bits(x[1], y[2]) + bits(x[2], y[1]))
    known = [x for x in data if x[0] is not None]
    want = sorted((x[0], y[0], dist(x, y)) for x in known for y in known if x[0] % 4 == 0 and x[0] != y[0])
    found = gp.distance_pairs(rows.where("id % 4 = 0"), rows)
    assert sorted(tuple(r) for r in found.collect()) == want
    sums = gp.distance_sums(rows.where("id % 4 = 0"), rows).collect()
    assert sum(r["n"] for r in sums) == len(want) and sum(r["total"] for r in sums) == sum(w[2] for w in want)
    assert min((r["low"], r["a"], r["low_b"]) for r in sums) == min((d, a, b) for a, b, d in want) and max(r["high"] for r in sums) == max(w[2] for w in want)
    single = known[:40]
    order = sorted(single, key=lambda x: (x[0] % 3, x[0]))
    place = {x[0]: i + 1 for i, x in enumerate(order)}
    nth = {x: i + 1 for i, x in enumerate(x[0] for x in order if x[0] % 4 == 0)}
    placed = spark.createDataFrame([(*x, place[x[0]], nth.get(x[0])) for x in single], "id long, strand1 array<long>, strand2 array<long>, place long, nth long")
    got = sorted((r["r"], r["a"], r["b"]) for r in gp.numbered_distance_pairs(placed.where("id % 4 = 0"), placed, 40).collect())
    pairs = sorted(((place[x[0]], place[y[0]], x[0], y[0]) for x in single for y in single if x[0] % 4 == 0 and x[0] != y[0]))
    assert got == [(i + 1, a, b) for i, (_, _, a, b) in enumerate(pairs)]


def _placed_genomes(spark, n):
    block = lambda s, k: F.conv(F.substring(F.md5(F.concat(F.lit(s), "id").cast("binary")), 1 + 8 * k, 8), 16, 10).cast("bigint")
    strands = [F.array(*(block(s, k) for k in range(3))).alias(s) for s in ("strand1", "strand2")]
    place = F.lit(n) - F.col("id")
    return spark.range(n).select("id", *strands, place.alias("place"), (F.floor((place - F.lit(n % 1000 or 1000)) / 1000) + 1).alias("nth"))


def _bytes_a_row(df, folder):
    df.write.parquet(str(folder))
    rows = df.sparkSession.read.parquet(str(folder)).count()
    return rows, sum(f.stat().st_size for f in folder.glob("*.parquet")) / rows


def test_numbered_pairs_take_little_disk(spark, tmp_path):
    """Apart from their numbers, each of which is another long, pairs take less than a byte and a half."""
    from cohortspark.operators import genome_pairs as gp

    g = _placed_genomes(spark, 25000)
    found = gp.numbered_distance_pairs(g.where("id % 1000 = 0"), g, 25000)
    rows, each = _bytes_a_row(found, tmp_path / "pairs")
    assert rows == 25 * 24999 and each < 6
    n = spark.read.parquet(str(tmp_path / "pairs")).agg(F.min("r"), F.max("r"), F.count_distinct("r")).first()
    assert tuple(n) == (1, rows, rows)


def test_pairs_take_little_disk(spark, tmp_path, monkeypatch):
    """Less than a byte and a half each; the same pairs from lists of other lengths."""
    from cohortspark.operators import genome_pairs as gp

    g = _placed_genomes(spark, 25000)
    rows, each = _bytes_a_row(gp.distance_pairs(g.where("id % 1000 = 0"), g), tmp_path / "pairs")
    assert rows == 25 * 24999 and each < 1.5
    for name, n in (("LIST", 3000), ("SAMPLE_LIST", 2), ("SAMPLE_LISTS", 3), ("CHUNK", 7000)):
        monkeypatch.setattr(gp, name, n)
    sums = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b", "dist").cast("decimal(38, 0)"))).first()
    assert sums(gp.distance_pairs(g.where("id % 1000 = 0"), g)) == sums(spark.read.parquet(str(tmp_path / "pairs")))


def test_cross_matrix_takes_little_disk(spark, tmp_path):
    """The other set has odd ids only."""
    from cohortspark.operators import genome_pairs as gp

    g = _placed_genomes(spark, 50000)
    rows, each = _bytes_a_row(gp.distance_pairs(g.where("id % 2000 = 0"), g.where("id % 2 = 1")), tmp_path / "pairs")
    assert rows == 25 * 25000 and each < 1.5


@pytest.mark.parametrize("held", [1, 40, 10**6])
@pytest.mark.parametrize("rule", ["likeness", "tens", "shared", "blocks"])
def test_pairs_of_a_cell_follow_the_total_order(held, rule, monkeypatch):
    """However many couples are held at once; equal genomes and scores of 0 are among them."""
    from functools import partial

    import pyarrow as pa

    monkeypatch.setattr(pairing, "COUPLES", held)
    draw = random.Random(rule)
    pool = [([draw.getrandbits(32) for _ in range(3)], [draw.getrandbits(32) for _ in range(3)]) for _ in range(30)]
    agents = [(i, i % 3 % 2, *draw.choice(pool)) for i in draw.sample(range(1000), 70)]
    table = pa.table({"cell": pa.array([4] * 70, pa.int32()), "id": [a[0] for a in agents], "gender": [a[1] for a in agents], "strand1": [a[2] for a in agents], "strand2": [a[3] for a in agents]})
    bits = lambda x, y: sum((p ^ q).bit_count() for p, q in zip(x, y, strict=True))
    dist = lambda f, m: min(bits(f[2], m[2]) + bits(f[3], m[3]), bits(f[2], m[3]) + bits(f[3], m[2]))
    own = lambda a, n: {x % n for x in a[2] + a[3]}
    of = {
        "likeness": (partial(pairing._ByDistance, score=partial(pairing.likeness, loci=96.0)), 0.5, lambda f, m: 1.0 - dist(f, m) / 192.0),
        "tens": (partial(pairing._ByDistance, score=pairing.tens), 8.0, lambda f, m: float(dist(f, m) // 10)),
        "shared": (partial(pairing._ByShared, modulus=16), 1.0, lambda f, m: float(len(own(f, 16) & own(m, 16)))),
        "blocks": (partial(pairing._ByShared, modulus=None), 0.0, lambda f, m: float(len(own(f, 1 << 40) & own(m, 1 << 40)))),
    }[rule]
    scored = [(of[2](f, m), f[0], m[0]) for f in agents if f[1] == 0 for m in agents if m[1] == 1]
    order = sorted((-s, pairing._u(3, 2, "greedy", f), f, pairing._u(3, 2, "choose", f, m), m) for s, f, m in scored if s >= of[1])
    want, taken = [], set()
    for s, _, f, _, m in order:
        if ("f", f) not in taken and ("m", m) not in taken:
            taken |= {("f", f), ("m", m)}
            want.append((4, f, m, -s))
    found = pairing._assortative(table, of[0], of[1], 3, 2)
    assert sorted(tuple(r.values()) for r in found.to_pylist()) == sorted(want)


def test_selected_pairs_match_the_rule_over_couples(spark):
    """Cells of one sex, genomes that are missing, weights of 0, more females than males."""
    from functools import partial

    from cohortspark.functions.curves import polyline

    draw = random.Random(2)
    strand = lambda: [draw.getrandbits(32) for _ in range(3)]
    rows = [(i, 9 if i % 10 == 0 else i % 4, 0 if i % 10 == 0 or i % 5 < 3 else 1, strand() if i % 17 else None, strand()) for i in range(150)]
    able = spark.createDataFrame(rows, "id long, cell int, gender int, strand1 array<long>, strand2 array<long>")
    knots = [(80.0, 0.0), (90.0, 1.0), (100.0, -0.5)]
    f, m = (able.where(F.col("gender") == k).select("cell", F.col("id").alias(n), F.col("strand1").alias(n + "1"), F.col("strand2").alias(n + "2")) for k, n in ((0, "female"), (1, "male")))
    both = f.join(m, "cell").where("female1 is not null and male1 is not null")
    both = both.withColumn("weight", polyline(g.diploid_distance(*map(F.col, ("female1", "female2", "male1", "male2"))).cast("double"), knots))
    want = sorted(tuple(r) for r in pairing.selective_pairs(both, 5, 6).collect())
    got = sorted(tuple(r) for r in pairing.selected_pairs(able, partial(pairing.curve, knots=knots), 5, 6).collect())
    assert len(want) > 20 and got == want


def test_shared_proteins_expand_classes(spark, monkeypatch):
    """Classes larger than a list, repeated ids and proteins, rows without any."""
    monkeypatch.setattr(genetics, "MEMBERS", 3)
    a = [(i, ["m"]) for i in range(20)] + [(20, ["m", "x", "m"]), (21, []), (22, ["z"]), (3, ["x"])]
    b = [(i, ["m"]) for i in range(100, 115)] + [(115, ["x", "m", "x"]), (116, ["q"]), (117, [])]
    found = genetics.shared_proteins(spark.createDataFrame(a, "a long, hashes array<string>"), spark.createDataFrame(b, "b long, hashes array<string>"))
    want = Counter((i, j) for i, p in a for x in p for j, q in b for y in q if x == y)
    rows = found.collect()
    assert len(rows) == len(want) and {(r["a"], r["b"]): r["n"] for r in rows} == want


def test_draws_and_places_are_made_once(spark):
    """A draw is no part of what is done per entry of the table; many places in few blocks, and none."""
    drawn = genetics.binomial_count(F.col("d"), 8192, 0.01)
    plan = spark.createDataFrame([(0.5,)], "d double").select(drawn.alias("n"))._jdf.queryExecution().analyzed().toString()
    assert plan.split("transform(array(d", 1)[1].count("d#") <= 2 and plan.count("transform(array(d") == 1
    data = [([5, 0, 7], [0, 31, 32, 31, 95, 64, 0]), ([1, 2, 3], []), ([0, 0, 0], [40]), ([0, 0, 0], [-1, 96, 95])]
    out = spark.createDataFrame(data, "s array<long>, p array<long>").select("s", "p", g.mutate(F.col("s"), F.col("p"), 32, 3).alias("m")).collect()
    for r in out:
        assert r["m"] == [w | sum({1 << (p % 32) for p in r["p"] if p // 32 == i and 0 <= p < 96}) for i, w in enumerate(r["s"])]
