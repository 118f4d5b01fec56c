"""Genomes along an ancestry graph in pieces of packed nodes: no row per bit or origin is shuffled.

Nodes are cut into pieces by ranges of ids. Each bit of a node is one bit of one strand of one parent. A
piece follows the bits of the nodes that other pieces need to constants or to nodes of other pieces, in
arrays; what is left are these nodes alone, which are pieced and followed in the same way. Their values
go back down, and every piece then gives its own nodes.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.lineage import cut

BITS = 32
#: Nodes in a piece; those that other pieces need may be this share of a level's nodes at most (joining two pieces leaves half).
PIECE, SHARE = 65536, 0.6
NODE, FOUNDER, SAMPLE = range(3)
#: What a bit ends in: constants, or (from OTHERS on) two strands for each node of another piece; a piece's own strands follow.
ZERO, ONE, UNKNOWN, OTHERS = range(4)
NO_PARENT = int(np.iinfo(np.int64).min)
FULL = (1 << BITS) - 1


def _blob(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def _arrays(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


def _places(ids: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Where the sorted ``ids`` hold each of ``own`` (-1: nowhere)."""
    if not len(ids):
        return np.full(len(own), -1, np.int64)
    at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
    return np.where(ids[at] == own, at, -1)


def _pack(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """One row for the nodes and founders of a partition; a founder is not evolved, of a repeated id one row counts."""
    whole = pa.Table.from_batches(batches).combine_chunks() if (batches := [b for b in batches if b.num_rows]) else None
    if whole is None:
        return
    kind, id_, mom, dad = (whole.column(c).to_numpy() for c in ("kind", "id", "mom", "dad"))
    ids = np.unique(id_[kind != SAMPLE])
    if not len(ids):
        return
    parents = np.full((2, len(ids)), NO_PARENT)
    nodes = np.flatnonzero(kind == NODE)
    nodes = nodes[np.lexsort((dad[nodes], mom[nodes], id_[nodes]))]
    own, first = np.unique(id_[nodes], return_index=True)
    parents[:, _places(ids, own)] = mom[nodes[first]], dad[nodes[first]]
    rows = np.flatnonzero(kind == FOUNDER)
    own, first = np.unique(id_[rows], return_index=True)
    founders = _places(ids, own)
    flat = whole.column("v").combine_chunks().take(pa.array(rows[first])).flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, 2, blocks)
    values = (flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, 2, blocks) & FULL).astype(np.uint32)
    parents[:, founders] = NO_PARENT
    picked = np.zeros(len(ids), bool)
    picked[(at := _places(ids, id_[kind == SAMPLE]))[at >= 0]] = True
    blob = _blob(ids=np.diff(ids, prepend=0), parents=ids - parents, founders=founders, values=values, known=known, picked=picked)
    yield pa.RecordBatch.from_pydict({"piece": whole.column("piece").to_numpy()[:1], "low": ids[:1], "n": [len(ids)], "blobs": [[blob]]}, schema=pa.schema([("piece", pa.int64()), ("low", pa.int64()), ("n", pa.int64()), ("blobs", pa.list_(pa.binary()))]))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Ids, parents and the rest of a packed piece."""
    d = _arrays(blob)
    ids = np.cumsum(d["ids"])
    return ids, ids - d["parents"], d


def _elsewhere(ids: np.ndarray, own: np.ndarray) -> np.ndarray:
    own = np.unique(own)
    return own[(_places(ids, own) < 0) & (own != NO_PARENT)]


def _needs(batches: Iterator[pa.RecordBatch], lows: np.ndarray, pieces: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Parents in other pieces, with the piece that would hold them."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, parents, _ = _unpack(row["blobs"][0])
            outs = _elsewhere(ids, parents.ravel())
            at = np.searchsorted(lows, outs, "right") - 1
            outs, at = outs[at >= 0], at[at >= 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(outs), row["piece"])), pa.array(pieces[at]), pa.array(outs)], names=["piece", "owner", "id"])


def _masks(tag: str, ids: np.ndarray, blocks: int) -> np.ndarray:
    """The blocks of ``random_mask``, one row each."""
    head = f"{tag}|".encode()
    digests = b"".join(hashlib.md5(head + b"%d" % i).digest() for i in ids.tolist())
    return np.ascontiguousarray(np.frombuffer(digests, ">u4").reshape(-1, 4)[:, :blocks].T.astype(np.uint32))


#: Ids, ids of nodes of other pieces, and where bit ``k`` of block ``b`` of each of the own strands comes from.
Links = tuple[np.ndarray, np.ndarray, Callable[[int, int], np.ndarray]]


def _packed_links(blob: bytes, blocks: int, seed: int) -> Links:
    ids, parents, d = _unpack(blob)
    outs = _elsewhere(ids, parents.ravel())
    start = OTHERS + 2 * len(outs)
    froms = []
    for own in parents:
        inside, outside = _places(ids, own), _places(outs, own)
        froms.append(np.where(inside >= 0, start + 2 * inside, np.where(outside >= 0, OTHERS + 2 * outside, UNKNOWN)).astype(np.int32))
    masks = [_masks(f"{seed}|evolve|{p}", ids, blocks) for p in ("mom", "dad")]
    founders = d["founders"]

    def first(b: int, k: int) -> np.ndarray:
        links = np.empty((len(ids), 2), np.int32)
        for s, (own, m) in enumerate(zip(froms, masks, strict=True)):
            links[:, s] = np.where(own == UNKNOWN, UNKNOWN, own + 1 - (m[b] >> k & 1).astype(np.int32))
        links[founders] = np.where(d["known"][:, :, b], d["values"][:, :, b] >> k & 1, UNKNOWN)
        return links.ravel()

    return ids, outs, first


def _joined_links(blobs: list[bytes], blocks: int) -> Links:
    parts = sorted((_arrays(b) for b in blobs), key=lambda d: d["ids"][0])
    ids = np.concatenate([d["ids"] for d in parts])
    outs = _elsewhere(ids, np.concatenate([d["outs"] for d in parts]))
    start = OTHERS + 2 * len(outs)
    tables = []
    for d in parts:
        inside, outside = _places(ids, d["outs"]), _places(outs, d["outs"])
        to = np.where(inside >= 0, start + 2 * inside, OTHERS + 2 * outside)
        tables.append(np.concatenate([np.arange(OTHERS), (to[:, None] + np.arange(2)).ravel()]).astype(np.int32))
    return ids, outs, lambda b, k: np.concatenate([t[d["links"][b * BITS + k]] for t, d in zip(tables, parts, strict=True)])


def _links(blobs: list[bytes], level: int, blocks: int, seed: int) -> Links:
    return _joined_links(blobs, blocks) if level else _packed_links(blobs[0], blocks, seed)


def _ends(first: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Where each of the own strands' bit ends: its way is doubled until it stays; what turns in circles is unknown."""
    start = OTHERS + len(others)
    to = np.concatenate([np.arange(OTHERS, dtype=np.int32), others, first])
    own = first
    for _ in range(len(first).bit_length() + 1):
        far = to[own]
        if np.array_equal(far, own):
            break
        own = far
        to[start:] = own
    return np.where(own < start, own, UNKNOWN)


def _narrow(batches: Iterator[pa.RecordBatch], level: int, blocks: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The nodes of a piece that others need, followed out of it."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, outs, first = _links(row["blobs"], level, blocks, seed)
            at = _places(ids, np.unique(np.array(row["wanted"], np.int64)))
            at = at[at >= 0]
            if not len(at):
                continue
            strands = (2 * at[:, None] + np.arange(2)).ravel()
            stay = np.arange(OTHERS, OTHERS + 2 * len(outs), dtype=np.int32)
            links = np.stack([_ends(first(b, k), stay)[strands] for b in range(blocks) for k in range(BITS)])
            yield pa.RecordBatch.from_pydict({"piece": [row["piece"]], "blob": [_blob(ids=ids[at], outs=outs, links=links)]}, schema=pa.schema([("piece", pa.int64()), ("blob", pa.binary())]))


def _evolved(blobs: list[bytes], given: list[dict] | None, level: int, blocks: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a piece, values and known bits of their strands (``n x 2 x blocks``); ``given`` has those of other pieces' nodes."""
    ids, outs, first = _links(blobs, level, blocks, seed)
    theirs = np.zeros((2, len(outs), 2, blocks), np.uint32)
    if given:
        at = _places(outs, np.array([g["id"] for g in given], np.int64))
        sent = np.frombuffer(b"".join(g["v"] for g in given), np.uint32).reshape(-1, 2, 2, blocks)
        theirs[:, at[at >= 0]] = sent[at >= 0].swapaxes(0, 1)
    values, known = np.zeros((2, len(ids), 2, blocks), np.uint32)
    for b in range(blocks):
        for k in range(BITS):
            value, is_known = (x[:, :, b].ravel() >> k & 1 for x in theirs)
            end = _ends(first(b, k), np.where(is_known == 1, value, UNKNOWN).astype(np.int32)).reshape(-1, 2)
            values[:, :, b] |= (end == ONE).astype(np.uint32) << k
            known[:, :, b] |= (end != UNKNOWN).astype(np.uint32) << k
    return ids, values, known


def _values(batches: Iterator[pa.RecordBatch], level: int, blocks: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, values, known = _evolved(row["blobs"], row["given"], level, blocks, seed)
            both = [np.stack([v, k]).tobytes() for v, k in zip(values, known, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(both, pa.binary())], names=["id", "v"])


def _born(batches: Iterator[pa.RecordBatch], blocks: int, seed: int, sampled: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, values, known = _evolved(row["blobs"], row["given"], 0, blocks, seed)
            d = _arrays(row["blobs"][0])
            give = (known == FULL).all(axis=(1, 2))
            give[d["founders"]] = False
            if sampled:
                give &= d["picked"]
            own = values[give].astype(np.int64)
            ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * blocks)
            strands = [pa.ListArray.from_arrays(ends, pa.array(own[:, s].ravel())) for s in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[give]), *strands], names=["id", "strand1", "strand2"])


def _spread(pieces: DataFrame, more: DataFrame, how: str, n: int) -> DataFrame:
    """A task for about each piece (few bytes make much work)."""
    return pieces.join(more, "piece", how).repartition(n, "piece")


def _solved(pieces: DataFrame, n: int, total: int, needs: DataFrame, level: int, size: int, blocks: int, seed: int) -> DataFrame | None:
    """``piece`` (in ``needs``) and ``given``: ids and values of the nodes of other pieces that a piece needs. None: these are too many."""
    if needs.isEmpty():
        return needs.sparkSession.createDataFrame([], "piece long, given array<struct<id:long,v:binary>>")
    nodes = needs.select("id").distinct().count()
    if nodes > SHARE * total:
        return None
    wanted = needs.groupBy(F.col("owner").alias("piece")).agg(F.collect_set("id").alias("wanted"))
    narrow = cut(_spread(pieces, wanted, "inner", n).mapInArrow(partial(_narrow, level=level, blocks=blocks, seed=seed), "piece long, blob binary"))
    join = max(2, size * n // nodes)
    up = lambda c: F.floor(F.col(c) / join).alias(c)
    above = cut(narrow.groupBy(up("piece")).agg(F.collect_list("blob").alias("blobs")))
    m, between = above.count(), cut(needs.select(up("piece"), up("owner"), "id").where("piece <> owner").distinct())
    given = _solved(above, m, nodes, between, level + 1, size, blocks, seed)
    if given is None:
        return None
    values = cut(_spread(above, given, "left", max(1, m)).mapInArrow(partial(_values, level=level + 1, blocks=blocks, seed=seed), "id long, v binary"))
    return cut(needs.join(values, "id").groupBy("piece").agg(F.collect_list(F.struct("id", "v")).alias("given")))


def evolved(parents: DataFrame, founders: DataFrame, blocks: int, seed: int, samples: DataFrame | None = None, size: int = PIECE) -> DataFrame | None:
    """``id, strand1, strand2`` of the nodes of ``parents`` (``id, mom, dad``; of ``samples`` only, if given) that are known
    and no founders themselves. None: too many parents are in other pieces than their children for pieces to help.
    """
    if not 0 < blocks <= 4:
        raise ValueError("a digest has four blocks")
    none = F.lit(NO_PARENT)
    long = lambda c: F.coalesce(F.col(c).cast("bigint"), none).alias(c)
    strands = F.array(*(F.get(s, F.lit(b)).cast("bigint") for s in ("strand1", "strand2") for b in range(blocks)))
    no_strands, id_ = F.lit(None).cast("array<bigint>").alias("v"), F.col("id").cast("bigint").alias("id")
    rows = parents.select(id_, F.lit(NODE).alias("kind"), long("mom"), long("dad"), no_strands)
    rows = rows.unionByName(founders.select(id_, F.lit(FOUNDER).alias("kind"), none.alias("mom"), none.alias("dad"), strands.alias("v")))
    if samples is not None:
        rows = rows.unionByName(samples.select(id_, F.lit(SAMPLE).alias("kind"), none.alias("mom"), none.alias("dad"), no_strands))
    ranges = rows.where("id is not null").repartitionByRange(max(1, -(-parents.count() // size)), "id")
    packed = cut(ranges.withColumn("piece", F.spark_partition_id().cast("bigint")).mapInArrow(partial(_pack, blocks=blocks), "piece long, low long, n long, blobs array<binary>"))
    bounds = packed.select("low", "piece", "n").orderBy("low").collect()
    lows, names = (np.array([r[c] for r in bounds], np.int64) for c in ("low", "piece"))
    needs = cut(packed.mapInArrow(partial(_needs, lows=lows, pieces=names), "piece long, owner long, id long"))
    pieces, n = packed.select("piece", "blobs"), max(1, len(bounds))
    given = _solved(pieces, n, sum(r["n"] for r in bounds), needs, 0, size, blocks, seed)
    if given is None:
        return None
    born = partial(_born, blocks=blocks, seed=seed, sampled=samples is not None)
    return _spread(pieces, given, "left", n).mapInArrow(born, "id long, strand1 array<long>, strand2 array<long>")
