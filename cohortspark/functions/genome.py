"""Bit-packed genomes as array columns: distances, recombination, mutation, text forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EVEN_BITS = 0x5555555555555555
NUCLEOTIDES = "AGCT"


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` evaluated once a row: an expression that a lambda names is evaluated for each entry."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v)


def popcount_distance(a: Column, b: Column) -> Column:
    """Differing bits of two strands (one bit a locus)."""
    return _sum(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")))


def popcount2_distance(a: Column, b: Column) -> Column:
    """Differing nucleotides of two strands (two bits a locus)."""

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        return F.bit_count((d.bitwiseOR(F.shiftrightunsigned(d, 1))).bitwiseAND(F.lit(EVEN_BITS))).cast("bigint")

    return _sum(F.zip_with(a, b, differing))


def diploid_distance(a1: Column, a2: Column, b1: Column, b2: Column, strand=popcount_distance) -> Column:
    """The lesser of the straight and the crossed pairing of strands."""
    return F.least(strand(a1, b1) + strand(a2, b2), strand(a1, b2) + strand(a2, b1))


def free_recombination(a: Column, b: Column, mask: Column) -> Column:
    """Each locus from one strand or the other by a random mask."""

    def mix(pair: Column, m: Column) -> Column:
        return pair["a"].bitwiseAND(m).bitwiseOR(pair["b"].bitwiseAND(F.bitwise_not(m)))

    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    return F.zip_with(pairs, mask, mix)


def crossover(a: Column, b: Column, breaks: Column, block_bits: int) -> Column:
    """Alternates between the strands at the given loci (an array of places); no loop over bits:
    a block's mask is the xor of the masks "from this place on" of all breaks."""
    full = (1 << block_bits) - 1

    def block(pair: Column, i: Column) -> Column:
        def from_place(p: Column) -> Column:
            k = F.least(F.greatest(p - i * block_bits, F.lit(0)), F.lit(block_bits))
            upper = F.lit(full).cast("bigint") - (F.call_function("shiftleft", F.lit(1).cast("bigint"), k.cast("int")) - 1)
            return F.when(k >= block_bits, F.lit(0).cast("bigint")).otherwise(upper)

        mask = F.aggregate(breaks, F.lit(0).cast("bigint"), lambda m, p: m.bitwiseXOR(from_place(p)))
        return pair["a"].bitwiseAND(F.bitwise_not(mask)).bitwiseOR(pair["b"].bitwiseAND(mask))

    return F.transform(F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b"))), block)


def mutate(strand: Column, places: Column, block_bits: int, blocks: int) -> Column:
    """Sets (never flips) the bits at the given places of a strand of ``blocks`` blocks.

    The places are sorted and folded into one mask per block that has any; ``places`` (often a costly
    expression) is evaluated once, and no block is visited for each place.
    """
    inside = F.array_sort(F.filter(places, lambda p: (p >= 0) & (p < block_bits * blocks)))
    none = F.array().cast("array<struct<at:int,m:bigint>>")

    def add(masks: Column, p: Column) -> Column:
        at, bit = F.floor(p / block_bits).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (p % block_bits).cast("int"))
        last = F.get(masks, F.size(masks) - 1)
        more = F.array(F.struct(at.alias("at"), last["m"].bitwiseOR(bit).alias("m")))
        return F.when(last["at"] == at, F.concat(F.slice(masks, 1, F.size(masks) - 1), more)).otherwise(F.concat(masks, F.array(F.struct(at.alias("at"), bit.alias("m")))))

    def spread(masks: Column) -> Column:
        gap = lambda e, i: e["at"] - F.coalesce(F.get(masks, i - 1)["at"], F.lit(-1)) - 1
        return F.flatten(F.transform(masks, lambda e, i: F.concat(F.array_repeat(F.lit(0).cast("bigint"), gap(e, i)), F.array(e["m"]))))

    all_masks = once(F.aggregate(inside, none, add), spread)
    return F.zip_with(strand, all_masks, lambda x, m: x.bitwiseOR(F.coalesce(m, F.lit(0).cast("bigint"))))


def code_at(strand: Column, locus: Column | int, block_bits: int, bits: int = 1) -> Column:
    """The code at a locus."""
    per = block_bits // bits
    locus = locus if isinstance(locus, Column) else F.lit(locus)
    word = F.get(strand, F.floor(locus / per).cast("int"))
    return F.call_function("shiftrightunsigned", word, (locus % per * bits).cast("int")).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def to_text(strand: Column, block_bits: int, loci: int) -> Column:
    """Two-bit codes as letters."""
    letter = lambda s, i: F.substring(F.lit(NUCLEOTIDES), code_at(s, i, block_bits, 2) + 1, F.lit(1))
    return once(strand, lambda s: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(loci - 1)), lambda i: letter(s, i)), ""))


def from_text(text: Column, block_bits: int) -> Column:
    """Letters as two-bit codes, packed into blocks."""
    per = block_bits // 2
    blocks = F.sequence(F.lit(0), F.ceil(F.length(text) / per).cast("int") - 1)

    def block(i: Column) -> Column:
        signs = F.split(F.substring(text, i * per + 1, F.lit(per)), "")
        codes = F.transform(signs, lambda c, k: F.call_function("shiftleft", (F.instr(F.lit(NUCLEOTIDES), c) - 1).cast("bigint"), (k * 2).cast("int")))
        return _sum(codes)

    return F.transform(blocks, block)
