"""Distances of a sample's genomes to all others, in blocks of packed genomes: no pair is shuffled.

Sums: rows are packed into chunks (one row of bytes each), the sample into blocks, and each chunk meets
each block in a task of its own, which counts differing bits in arrays. Pairs: both sides are packed into
lists, lists meet lists, and are expanded by generated code, in an order in which Parquet stores one column
as runs and another one as a short sequence that repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.lineage import cut
from cohortspark.operators.genetics import BLOCK_BITS

CHUNK, BLOCK = 32768, 512
#: Genomes in a list of the rows (it comes again for each of the sample: short enough for a codec to see that) and of the
#: sample (two lists are expanded at a time, in memory), lists of the sample and about so many pairs in a task.
LIST, SAMPLE_LIST, SAMPLE_LISTS, PAIRS = 256, 16, 2048, 1 << 24


def packed_words(strands: list[np.ndarray]) -> np.ndarray:
    """Strands (``n x blocks`` of 32-bit blocks as longs) side by side, in rows of 64-bit words."""
    both = np.concatenate(strands, axis=1).astype(np.uint32)
    return np.ascontiguousarray(both).view(np.uint64)


def words_of(strand1: np.ndarray, strand2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of both strands in order, and crossed; each word is a row, so that a genome is a column."""
    return tuple(np.ascontiguousarray(packed_words(s).T) for s in ([strand1, strand2], [strand2, strand1]))


def distances_to(one: np.ndarray, straight: np.ndarray, crossed: np.ndarray) -> np.ndarray:
    """Distances of a genome (its words in order) to all columns: the lesser of the straight and the crossed pairing."""
    kind = np.uint8 if 64 * len(one) < 256 else np.int32

    def differing(words: np.ndarray) -> np.ndarray:
        total = np.bitwise_count(words[0] ^ one[0]).astype(kind, copy=False)
        for x, w in zip(one[1:], words[1:], strict=True):
            total += np.bitwise_count(w ^ x)
        return total

    return np.minimum(differing(straight), differing(crossed))


def matrix(column: pa.Array, n: int) -> np.ndarray:
    """``n`` lists of equal length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _pack(batches: Iterator[pa.RecordBatch], size: int, extra: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """One row per about ``size`` genomes in the order of their ids."""
    whole = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
    if whole is None:
        return
    whole = whole.combine_chunks().sort_by("id")
    step = -(-whole.num_rows // max(1, round(whole.num_rows / size)))
    for at in range(0, whole.num_rows, step):
        part = whole.slice(at, step).combine_chunks()
        n, one = part.num_rows, lambda c: part.column(c).chunk(0)  # noqa: B023
        words = [w.tobytes() for w in words_of(matrix(one("strand1"), n), matrix(one("strand2"), n))]
        longs = np.stack([part.column(c).to_numpy().astype(np.int64) for c in ("id", *extra)])
        yield pa.RecordBatch.from_pydict({"n": [n], "longs": [longs.tobytes()], "straight": [words[0]], "crossed": [words[1]]}, schema=pa.schema([("n", pa.int64()), *((c, pa.binary()) for c in ("longs", "straight", "crossed"))]))


def _packed(genomes: DataFrame, size: int, extra: tuple[str, ...]) -> DataFrame:
    """Packed rows, one partition for about ``size`` of them."""
    rows = genomes.where("id is not null").select("id", "strand1", "strand2", *extra)
    parts = max(1, -(-rows.count() // size))
    pack = partial(_pack, size=size, extra=extra)
    return cut(rows.repartition(parts).mapInArrow(pack, "n long, longs binary, straight binary, crossed binary"))


def _meet(batches: Iterator[pa.RecordBatch], give: Callable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            side = lambda p, c, kind: np.frombuffer(row[p + c], kind).reshape(-1, row[p + "n"])  # noqa: B023, E731
            a, b = ((side(p, "longs", np.int64), side(p, "straight", np.uint64), side(p, "crossed", np.uint64)) for p in ("a_", "b_"))
            yield from give(a[0], np.ascontiguousarray(a[1].T), *b)


def _met(sample: DataFrame, rows: DataFrame, give: Callable, schema: str, extra_a: tuple[str, ...] = (), extra_b: tuple[str, ...] = ()) -> DataFrame:
    side = lambda df, p: df.select(*(F.col(c).alias(p + c) for c in df.columns))
    a, b = side(_packed(sample, BLOCK, extra_a), "a_"), side(_packed(rows, CHUNK, extra_b), "b_")
    return a.hint("shuffle_replicate_nl").crossJoin(b).mapInArrow(partial(_meet, give=give), schema)


def _own(ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted ``ids`` hold each of ``own``: first places, and those behind the last ones."""
    return np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")


def _list(batches: Iterator[pa.RecordBatch], size: int, order: str, sources: list[str], names: list[str]) -> Iterator[pa.RecordBatch]:
    """One row per ``size`` genomes in ``order``: a list of their longs ``sources`` and of as many words as there are ``names`` left."""
    whole = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
    if whole is None:
        return
    whole = whole.combine_chunks().sort_by(order).combine_chunks()
    n, one = whole.num_rows, lambda c: whole.column(c).chunk(0)
    words = np.concatenate(words_of(matrix(one("strand1"), n), matrix(one("strand2"), n))).view(np.int64)[: len(names) - len(sources)]
    rows = pa.StructArray.from_arrays([*(one(c).cast(pa.int64()) for c in sources), *(pa.array(w) for w in words)], names=names)
    for at in range(0, n, size):
        part = rows.slice(at, size)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)], names=["list"])


def _listed(genomes: DataFrame, parts: int, size: int, order: str, longs: dict[str, str], words: list[str]) -> DataFrame:
    """Lists of structs of ``longs`` (old names by new ones) and ``words`` (those in order, then those crossed)."""
    rows = genomes.select(*dict.fromkeys(longs.values()), "strand1", "strand2")
    dealt = rows.repartition(parts) if order == "id" else rows.repartitionByRange(parts, order)
    names = [*longs, *words]
    pack = partial(_list, size=size, order=order, sources=list(longs.values()), names=names)
    return cut(dealt.mapInArrow(pack, f"list array<struct<{', '.join(f'{c}: long' for c in names)}>>"))


def _expanded(sample: DataFrame, rows: DataFrame, order: str, a: dict[str, str], b: dict[str, str]) -> DataFrame:
    """The pairs' longs (old names by new ones) and ``dist``: a list of rows with each of the sample in turn."""
    sample, rows = (df.where("id is not null") for df in (sample, rows))
    n_a, (n_b, words) = sample.count(), rows.agg(F.count("*"), F.max(F.size("strand1"))).first()
    own, straight, crossed = ([f"{side}{k}" for k in range(words or 0)] for side in ("own", "straight", "crossed"))
    lists = max(1, -(-n_b // LIST))
    tasks = max(-(-n_a * n_b // PAIRS), -(-n_b // CHUNK), min(2 * rows.sparkSession.sparkContext.defaultParallelism, lists))
    of_a = _listed(sample, max(1, -(-n_a // (SAMPLE_LIST * SAMPLE_LISTS))), SAMPLE_LIST, order, a, own).select(F.col("list").alias("list_a"))
    of_b = _listed(rows, min(tasks, lists), LIST, order, b, [*straight, *crossed]).select(F.col("list").alias("list_b"))
    met = of_b.hint("shuffle_replicate_nl").crossJoin(of_a).select("list_b", F.inline("list_a"))
    bits = lambda other: reduce(lambda x, y: x + y, (F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(own, other, strict=True)), F.lit(0))
    pairs = met.select(*a, *own, F.inline("list_b")).where("a <> b")
    return pairs.select(*a, *b, F.least(bits(straight), bits(crossed)).cast("bigint").alias("dist"))


def distance_pairs(sample: DataFrame, rows: DataFrame) -> DataFrame:
    """``a, b, dist`` of every row of ``sample`` and every one of ``rows`` with another id; both have ``id, strand1, strand2`` (blocks of 32 bits)."""
    return _expanded(sample, rows, "id", {"a": "id"}, {"b": "id"})


def numbered_distance_pairs(sample: DataFrame, rows: DataFrame, total: int) -> DataFrame:
    """As ``distance_pairs``, with ``r``, the pair's place from 1 in the order of (place of a, place of b).

    ``place`` is a row's place from 1 among all ``total`` rows, ``nth`` a sampled row's place in the sample: a pair's
    place follows from its partners' places (the sample's rows before it have ``total - 1`` pairs each, its own row is
    left out), and pairs are not sorted. Ids have to tell rows apart.
    """
    pairs = _expanded(sample, rows, "place", {"a": "id", "nth": "nth", "place_a": "place"}, {"b": "id", "place_b": "place"})
    r = (F.col("nth") - 1) * F.lit(total - 1).cast("bigint") + F.col("place_b") - (F.col("place_b") > F.col("place_a")).cast("bigint")
    return pairs.select(r.alias("r"), "a", "b", "dist")


def _sums(a: np.ndarray, a_words: np.ndarray, b: np.ndarray, straight: np.ndarray, crossed: np.ndarray) -> Iterator[pa.RecordBatch]:
    left, right = _own(b[0], a[0])
    out = []
    for i, own in enumerate(a[0]):
        dist = distances_to(a_words[i], straight, crossed)
        others = b[0]
        if right[i] > left[i]:
            mask = np.ones(len(dist), bool)
            mask[left[i] : right[i]] = False
            dist, others = dist[mask], others[mask]
        if len(dist):
            least = int(dist.argmin())
            out.append((int(own), len(dist), int(dist.sum(dtype=np.int64)), int(dist[least]), int(dist.max()), int(others[least])))
    names = ("a", "n", "total", "low", "high", "low_b")
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 6)], names=names)


def distance_sums(sample: DataFrame, rows: DataFrame) -> DataFrame:
    """``a, n, total, low, high, low_b`` of the pairs of ``distance_pairs``, one row per sampled genome and chunk of the others:
    number, sum, least and largest distance, and the least id at the least distance."""
    return _met(sample, rows, _sums, "a long, n long, total long, low long, high long, low_b long")
