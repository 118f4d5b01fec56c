"""Population-genetic operators over array genomes and phenomes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.draws import u
from cohortspark.functions.genome import code_at, crossover, free_recombination, mutate, once
from cohortspark.functions.lineage import cut

BLOCK_BITS = 32


def digest_block(tag: str, *parts: Column | int, at: int = 1) -> Column:
    """32 random bits as a long, a function of its arguments."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(tag), *cols).cast("binary")), at, 8), 16, 10).cast("bigint")


def random_mask(tag: str, id_: Column, blocks: int) -> Column:
    return F.array(*(digest_block(tag, id_, at=1 + 8 * b) for b in range(blocks)))


def random_places(tag: str, id_: Column, n: int, loci: int) -> Column:
    """``n`` places drawn from 0..loci-1 (repeats possible)."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: digest_block(tag, id_, k) % loci)


def binomial_table(n: int, rate: float) -> tuple[int, list[float]]:
    """``low`` and P(X <= low), P(X <= low + 1), ... of Binomial(n, rate), between the tails that a draw of 32 bits cannot reach."""
    if rate <= 0 or n <= 0:
        return 0, []
    if rate >= 1:
        return n, []
    low, total, table = 0, 0.0, []
    for k in range(n):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate))
        if total < 2.0**-33:
            low = k + 1
        elif total < 1 - 2.0**-33:
            table.append(total)
        else:
            break
    return low, table


def binomial_count(draw: Column, n: int, rate: float) -> Column:
    """The quantile of Binomial(n, rate) at a uniform draw of 32 bits, by its cumulated table (built here, no UDF)."""
    low, table = binomial_table(n, rate)
    if not table:
        return F.lit(low)
    count = lambda d: F.size(F.filter(F.array(*map(F.lit, table)), lambda t: d >= t))
    return once(draw, count) + low


def offspring(parents: DataFrame, blocks: int, loci: int, seed: int, step: int, breaks: int = -1, rate: float = 0.01) -> DataFrame:
    """``id, strand1, strand2`` of children from rows of ``id`` with ``m1, m2, d1, d2``.

    Each parent recombines its strands (``breaks`` > 0: crossover at that many places, -1: freely,
    0: not), passes on one of the two results, and mutations set bits.
    """

    def gamete(a: str, b: str, who: str) -> Column:
        x, y = F.col(a), F.col(b)
        if breaks > 0:
            places = random_places(f"{seed}|{step}|break|{who}", F.col("id"), breaks, loci)
            x, y = crossover(x, y, places, BLOCK_BITS), crossover(y, x, places, BLOCK_BITS)
        elif breaks < 0:
            m = random_mask(f"{seed}|{step}|mask|{who}", F.col("id"), blocks)
            x, y = free_recombination(x, y, m), free_recombination(y, x, m)
        one = F.when(u(seed, step, f"pick|{who}", F.col("id")) < 0.5, x).otherwise(y)
        n = binomial_count(u(seed, step, f"nmut|{who}", F.col("id")), loci, rate)
        places = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: digest_block(f"{seed}|{step}|mut|{who}", F.col("id"), k) % loci)
        return mutate(one, F.when(n > 0, places).otherwise(F.array().cast("array<bigint>")), BLOCK_BITS, blocks)

    return parents.select("id", gamete("m1", "m2", "m").alias("strand1"), gamete("d1", "d2", "d").alias("strand2"))


def hardy_weinberg(ids: DataFrame, rates: list[tuple[float, int]], blocks: int, seed: int) -> DataFrame:
    """Zero genomes in which each chosen site is set, per strand, with its rate."""

    def strand(s: int) -> Column:
        places = F.array_compact(F.array(*(F.when(u(seed, 0, f"hw{s}|{site}", F.col("id")) < rate, F.lit(site).cast("bigint")) for rate, site in rates)))
        return mutate(F.array_repeat(F.lit(0).cast("bigint"), blocks), places, BLOCK_BITS, blocks)

    return ids.select("id", strand(1).alias("strand1"), strand(2).alias("strand2"))


def allele_counts(genomes: DataFrame, loci: int, bits: int = 1) -> DataFrame:
    """``locus, code, n`` over both strands."""
    places = F.sequence(F.lit(0), F.lit(loci - 1))
    both = genomes.select(F.explode(F.array("strand1", "strand2")).alias("s"))
    codes = both.select(F.posexplode(F.transform(places, lambda i: code_at(F.col("s"), i, BLOCK_BITS, bits))).alias("locus", "code"))
    return codes.groupBy("locus", "code").agg(F.count("*").alias("n"))


def variability(counts: DataFrame) -> DataFrame:
    """``locus, n_codes, non_zero``: distinct codes, and the count of codes other than 0."""
    return counts.groupBy("locus").agg(F.count_distinct("code").alias("n_codes"), F.sum(F.when(F.col("code") != 0, F.col("n")).otherwise(F.lit(0))).alias("non_zero"))


def ordered_frequencies(counts: DataFrame, loci: int) -> DataFrame:
    """``rank, mean``: per locus the counts sorted descending, averaged by rank over all loci."""
    w = Window.partitionBy("locus").orderBy(F.col("n").desc(), "code")
    return counts.withColumn("rank", F.row_number().over(w)).groupBy("rank").agg((F.sum("n") / F.lit(float(loci))).alias("mean"))


def segment_distances(a: Column, b: Column, segments: int, loci: int) -> Column:
    """Differing loci in each of ``segments`` equal pieces."""
    size = loci // segments

    def one(s: Column) -> Column:
        places = F.sequence(s * size, (s + 1) * size - 1)
        diffs = F.transform(places, lambda i: (code_at(a, i, BLOCK_BITS) != code_at(b, i, BLOCK_BITS)).cast("int"))
        return F.aggregate(diffs, F.lit(0), lambda x, y: x + y)

    return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), one)


def phenome_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two vectors."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, v: s + v))


def mix_phenomes(a: Column, b: Column, draw: Column | None = None) -> Column:
    """The mean of two phenomes, or one of them by a draw."""
    if draw is not None:
        return F.when(draw < 0.5, a).otherwise(b)
    return F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2)


def gaussian(first: Column, second: Column, sigma: float) -> Column:
    """A normal draw from two uniform ones."""
    return F.lit(sigma) * F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - first)) * F.cos(F.lit(2 * math.pi) * second)


def mutate_phenome(values: Column, sigma: float, seed: int, step: int, id_: Column) -> Column:
    """Every trait nudged by a normal draw of its own."""
    return F.transform(values, lambda x, i: x.cast("double") + gaussian(u(seed, step, "nudge", id_, i), u(seed, step, "turn", id_, i), sigma))


def mean_strand_distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Euclidean distance of two phenomes whose strands are averaged."""
    return phenome_distance(mix_phenomes(a1, a2), mix_phenomes(b1, b2))


#: The standard genetic code in TCAG order.
CODONS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def proteins(text: Column) -> Column:
    """Proteins of a nucleotide text: from each Met to the next stop or the end; triplets in frame."""
    return once(text, _proteins)


def _proteins(text: Column) -> Column:
    place = lambda c: F.instr(F.lit("TCAG"), c) - 1
    letter = lambda i, k: F.substring(text, i * 3 + k + 1, F.lit(1))
    code = lambda i: place(letter(i, 0)) * 16 + place(letter(i, 1)) * 4 + place(letter(i, 2))
    n = F.floor(F.length(text) / 3).cast("int")
    amino = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(F.lit(CODONS), code(i) + 1, F.lit(1)))
    found = F.regexp_extract_all(F.array_join(amino, ""), F.lit(r"M[^*]*"), F.lit(0))
    return F.when(n > 0, found).otherwise(F.array().cast("array<string>"))


def protein_hashes(text: Column) -> Column:
    return F.transform(proteins(text), lambda p: F.md5(p.cast("binary")))


#: Ids in a list of a class's members, and tasks that expand pairs of lists (a fixed number: few bytes make many rows).
MEMBERS, LIST_TASKS = 512, 96


def shared_proteins(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a, b, n``: equal pairs of proteins (duplicates multiply) of rows ``a, hashes`` and ``b, hashes``.

    Rows with the same proteins are one class: classes are joined by protein, and each pair of classes is
    expanded at the end, in lists of about ``MEMBERS`` ids, so that neither the pairs are shuffled nor one
    frequent protein makes one task.
    """

    def classes(rows: DataFrame, id_: str, n: str) -> tuple[DataFrame, DataFrame]:
        # outer: no filter is derived that would make the proteins twice
        own = rows.select(id_, F.explode_outer("hashes").alias("p")).where("p is not null").groupBy(id_).agg(F.sort_array(F.collect_list("p")).alias("ps"))
        own = cut(own.select(id_, F.sha2(F.array_join("ps", ","), 256).alias(f"k{id_}"), "ps"))
        sizes = own.groupBy(f"k{id_}").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias(f"parts{id_}"), F.first("ps").alias("ps"))
        proteins = sizes.select(f"k{id_}", f"parts{id_}", F.explode("ps").alias("p")).groupBy(f"k{id_}", f"parts{id_}", "p").agg(F.count("*").alias(n))
        part = F.pmod(F.xxhash64(id_), F.col(f"parts{id_}")).cast("int").alias(f"part{id_}")
        members = own.select(id_, f"k{id_}").join(sizes.drop("ps"), f"k{id_}").groupBy(f"k{id_}", part).agg(F.collect_list(id_).alias(f"{id_}s"))
        return proteins, members

    (left, of_a), (right, of_b) = classes(a, "a", "x"), classes(b, "b", "y")
    pairs = left.join(right, "p").groupBy("ka", "kb", "partsa", "partsb").agg(F.sum(F.col("x") * F.col("y")).alias("n"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    lists = pairs.withColumn("parta", each("partsa")).withColumn("partb", each("partsb")).join(of_a, ["ka", "parta"]).join(of_b, ["kb", "partb"])
    spread = lists.select("n", "as", "bs", "ka", "kb", "parta", "partb").repartition(LIST_TASKS, "ka", "kb", "parta", "partb")
    return spread.select("n", "bs", F.explode("as").alias("a")).select("a", F.explode("bs").alias("b"), "n")


def principal_coordinates(distances: DataFrame, axes: int, landmarks: int = 64) -> DataFrame:
    """``id, axis, value, eigenvalue`` of all ids from ``id, landmark, dist``: distances to at most ``landmarks`` rows.

    The landmarks' own matrix (a bounded square) is double-centred and decomposed on the driver; every
    row, landmarks included, is placed by its distances to them, which for landmarks gives the principal
    coordinates themselves. Axes by falling eigenvalue, positive ones only; the largest entry of each
    axis is positive.
    """
    names = [r[0] for r in distances.select("landmark").distinct().orderBy("landmark").limit(landmarks + 1).collect()]
    if len(names) > landmarks:
        raise ValueError(f"more than {landmarks} landmarks")
    at = {name: i for i, name in enumerate(names)}
    own = distances.join(distances.select(F.col("landmark").alias("id")).distinct(), "id", "left_semi").collect()
    squares = np.zeros((len(names), len(names)))
    for r in own:
        squares[at[r["id"]], at[r["landmark"]]] = float(r["dist"]) ** 2
    means = squares.mean(axis=0)
    centred = -0.5 * (squares - means[:, None] - means[None, :] + means.mean())
    values, vectors = np.linalg.eigh(centred)
    order = [k for k in np.argsort(-values, kind="stable") if values[k] > 1e-9][:axes]
    row = distances.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("landmark", "dist"))).alias("d"))
    off = F.transform(F.col("d"), lambda e, i: F.get(F.array(*map(F.lit, means.tolist())), i) - e["dist"].cast("double") * e["dist"])
    placed = []
    for n, k in enumerate(order):
        v = vectors[:, k] * (1 if vectors[np.argmax(np.abs(vectors[:, k])), k] >= 0 else -1) / (2 * math.sqrt(values[k]))
        dot = F.aggregate(F.zip_with("off", F.array(*map(F.lit, v.tolist())), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        placed.append(F.struct(F.lit(n).alias("axis"), dot.alias("value"), F.lit(float(values[k])).alias("eigenvalue")))
    if not placed:
        return row.select("id", F.lit(0).alias("axis"), F.lit(0.0).alias("value"), F.lit(0.0).alias("eigenvalue")).where("false")
    return row.withColumn("off", off).select("id", F.inline(F.array(*placed)))
