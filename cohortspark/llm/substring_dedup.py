"""Substring dedup by de Bruijn compaction over token k-mers.

The graph's edges are the windows of ``WINDOW`` words, its nodes the word sequences that two
neighbouring windows share. It is built and compacted in buckets, as assemblers do: of the k-mers
of ``K`` words in a window the one with the least hash is its minimizer, all occurrences of an edge
have the same one, and a document enters a minimizer's bucket with maximal runs of windows
(pieces). A piece is labelled by a 128-bit digest of its words.

* A bucket whose pieces all have one key holds no repeat and is left out.
* A bucket with one label is one nonbranching path: it was first seen in the least document of it.
* In a bucket with several labels later occurrences of a label repeat its least document as a
  whole. The least occurrences become rows of edges: a rolling hash of the edge, a digest of its
  words, and the words before and after it. An edge's least document and source coordinate follow
  from an aggregation; where all its occurrences have the same neighbours its nodes have one way in
  and one way out. A join brings both back to the edges that a smaller document has, and runs of
  neighbouring edges compact into paths: nonbranching ones that go on at the source, too.

Every path is an occurrence (document, first window, number of windows) with its source (least
document, first window there); covered words come out as spans. A repeat is taken for one only if
digests of the words at both coordinates agree: of the piece (128 bits) or of the edge (64 bits
beside the 64 of the rolling hash). No pairs of documents are made; heavy minimizers, labels and
edges are aggregated before they are shuffled, and joined with tables that adaptive execution can
split.

Defined results: a null text has no words; repeated rows with one key are removed by documents of
smaller keys only; rows with a null key neither remove nor lose words; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.lineage import cut_to_table

WINDOW = 50
K = 12
#: Windows in one piece at most: repetitive texts keep one minimizer for very long.
PIECE_WINDOWS = 64
_BASE = 0x9E3779B97F4A7C15
_CHUNK_WORDS = 1 << 18


class Words:
    """The words of a whole text: 64-bit ids and, by slices, their own bytes."""

    def __init__(self, text: str | None, seen: dict[bytes, int]):
        words = (text or "").encode().split()  # bytes.split() cuts at the six ASCII spaces
        if len(seen) > 1 << 18:
            seen.clear()
        ids = []
        for w in words:
            i = seen.get(w)
            if i is None:
                i = seen[w] = xxhash.xxh3_64_intdigest(w)
            ids.append(i)
        self.ids = np.array(ids, np.uint64)
        self.joined = b" ".join(words)
        self.starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])

    def digest(self, first: int, n: int, size: int) -> bytes:
        """Of ``n`` words from ``first`` on."""
        return hashlib.blake2b(self.joined[self.starts[first] : self.starts[first + n] - 1], digest_size=size).digest()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words from each place on."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    powers = np.full(len(ids), _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    back = np.full(len(ids), pow(_BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * back, dtype=np.uint64)])
    return _mix((total[n:] - total[:-n]) * powers[: len(ids) - n + 1])


def minimizers(ids: np.ndarray, window: int = WINDOW, k: int = K) -> np.ndarray:
    """The minimizer of each window (the least hash of its k-mers)."""
    n = len(ids)
    if n < window:
        return np.empty(0, np.uint64)
    # Sliding minimum by doubling: spans of 1, 2, 4, ... k-mers, then two that overlap.
    low, reach, span = rolling(ids, k), window - k + 1, 1
    while span * 2 <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[: n - window + 1], low[reach - span : reach - span + n - window + 1])


def pieces(ids: np.ndarray, window: int = WINDOW, k: int = K) -> list[tuple[int, int, int]]:
    """(minimizer, first window, windows) of each maximal run, cut at ``PIECE_WINDOWS``."""
    out = []
    for at in range(0, max(0, len(ids) - window + 1), _CHUNK_WORDS):
        least = minimizers(ids[at : at + _CHUNK_WORDS + window - 1], window, k)
        ends = np.concatenate([np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]]).tolist()
        start = 0
        for end in ends:
            value = int(least[start].view(np.int64))
            while start < end:
                n = min(PIECE_WINDOWS, end - start)
                out.append((value, at + start, n))
                start += n
    return out


def _neighbours(ids: np.ndarray, first: int, windows: int, window: int) -> np.ndarray:
    """The words before and after each window of a piece in one long; 0 beyond the piece's ends."""
    short = (ids[first : first + windows + window - 1] & np.uint64(0x3FFFFFFF)) + np.uint64(1)
    before, after = np.zeros(windows, np.uint64), np.zeros(windows, np.uint64)
    before[1:] = short[: windows - 1]
    after[:-1] = short[window:]
    return (before << np.uint64(32) | after).view(np.int64)


def _halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0].copy(), pa.int64()), pa.array(both[:, 1].copy(), pa.int64())


def graph_pieces(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """``key, h, m, l1, l2, first, windows``: the pieces of every row of ``key, h, text``.

    ``m`` is the minimizer, ``l1`` and ``l2`` are the halves of the label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            rows, found, labels = [], [], []
            for row, value in enumerate(batch.column(2)):
                words = Words(value.as_py(), seen)
                for piece in pieces(words.ids, window, k):
                    rows.append(row)
                    found.append(piece)
                    labels.append(words.digest(piece[1], piece[2] + window - 1, 16))
                if rows and (len(rows) > 50_000 or row + 1 == batch.num_rows):
                    m, first, n = zip(*found, strict=True)
                    places = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(places), batch.column(1).take(places), pa.array(m, pa.int64()), *_halves(labels),
                         pa.array(first, pa.int32()), pa.array(n, pa.int32())],
                        names=["key", "h", "m", "l1", "l2", "first", "windows"],
                    )
                    rows, found, labels = [], [], []

    long, integer = T.LongType(), T.IntegerType()
    schema = T.StructType(
        [docs.schema["key"], *(T.StructField(n, long) for n in ("h", "m", "l1", "l2")), T.StructField("first", integer), T.StructField("windows", integer)]
    )
    return docs.select("key", "h", "text").mapInArrow(run, schema)


def edges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``key, h, first, at, e, v, beside``: the edges in the ``pieces`` of rows of ``key, h, text, pieces``.

    ``first`` is the piece, ``at`` the window; ``e`` is the edge's rolling hash, ``v`` the digest of
    its words, ``beside`` holds the words before and after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        names = ["key", "h", "first", "at", "e", "v", "beside"]
        for batch in batches:
            rows, firsts, ats, hashes, digests, beside = [], [], [], [], [], []
            held = 0
            for row in range(batch.num_rows):
                words = Words(batch.column(2)[row].as_py(), seen)
                own = batch.column(3)[row].values
                for first, n in zip(own.field("first").to_pylist(), own.field("windows").to_pylist(), strict=True):
                    rows.append(np.full(n, row))
                    firsts.append(np.full(n, first, np.int32))
                    ats.append(np.arange(first, first + n, dtype=np.int32))
                    hashes.append(rolling(words.ids[first : first + n + window - 1], window).view(np.int64))
                    digests += [words.digest(at, window, 8) for at in range(first, first + n)]
                    beside.append(_neighbours(words.ids, first, n, window))
                    held += n
                if rows and (held > 50_000 or row + 1 == batch.num_rows):
                    places = pa.array(np.concatenate(rows))
                    columns = [pa.array(np.concatenate(x)) for x in (firsts, ats, hashes)]
                    columns += [pa.array(np.frombuffer(b"".join(digests), np.int64)), pa.array(np.concatenate(beside))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(places), batch.column(1).take(places), *columns], names=names)
                    rows, firsts, ats, hashes, digests, beside = [], [], [], [], [], []
                    held = 0

    long, integer = T.LongType(), T.IntegerType()
    kinds = {"h": long, "first": integer, "at": integer, "e": long, "v": long, "beside": long}
    schema = T.StructType([docs.schema["key"], *(T.StructField(n, t) for n, t in kinds.items())])
    return docs.select("key", "h", "text", "pieces").mapInArrow(run, schema)


def compact(hits: DataFrame) -> DataFrame:
    """``key, h, path`` from edges ``key, h, first, at, least, source, plain``: neighbouring edges of a piece
    compact into one path (``first, windows, least, source``) where both are plain and go on at the source.
    Equal rows of a document count once, so a group is no larger than a piece."""
    kind = f"array<struct<first:int,windows:int,least:{hits.schema['least'].dataType.simpleString()},source:int,plain:boolean>>"
    found = hits.groupBy("key", "h", "first").agg(F.sort_array(F.collect_set(F.struct("at", "least", "source", "plain"))).alias("es"))

    def step(paths: Column, e: Column) -> Column:
        last = F.element_at(paths, -1)
        on = e["plain"] & last["plain"] & (e["least"] == last["least"])
        on = on & (e["at"] == last["first"] + last["windows"]) & (e["source"] == last["source"] + last["windows"])
        new = F.struct(e["at"].alias("first"), F.lit(1).alias("windows"), e["least"].alias("least"), e["source"].alias("source"), e["plain"].alias("plain"))
        longer = F.struct(last["first"].alias("first"), (last["windows"] + 1).alias("windows"), last["least"].alias("least"), last["source"].alias("source"), last["plain"].alias("plain"))
        grown = F.concat(F.slice(paths, F.lit(1), F.size(paths) - 1), F.array(longer))
        return F.when((F.size(paths) > 0) & on, grown).otherwise(F.concat(paths, F.array(new))).cast(kind)

    return found.select("key", "h", F.explode(F.aggregate("es", F.array().cast(kind), step)).alias("path"))


def _listed(spans: DataFrame, name: str) -> DataFrame:
    """One row per document with the array of its own (first, windows)."""
    return spans.groupBy("key", "h").agg(F.collect_set(F.struct("first", "windows")).alias(name))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """``key, text, spans``: for every row the (first, windows) runs whose windows also start in a smaller document.

    A run covers the words ``first`` to ``first + windows + window - 2``; null where nothing repeats.
    """
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    found, drop_found = cut_to_table(graph_pieces(rows.where(F.col("key").isNotNull()), window, k))
    # Aggregates go to tables of their own: a join that reads them can be split by adaptive execution.
    buckets = found.groupBy("m").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.min("l1").alias("one"), F.max("l1").alias("other"))
    buckets, drop_buckets = cut_to_table(buckets.where("least < most").select("m", "least", (F.col("one") != F.col("other")).alias("branching")))
    shared, _ = cut_to_table(found.join(buckets, "m").drop("m"))
    drop_found()
    drop_buckets()
    whole = shared.where("not branching and key > least").select("key", "h", "first", "windows")
    branches = shared.where("branching").select("key", "h", "l1", "l2", "first", "windows")
    labels, drop_labels = cut_to_table(branches.groupBy("l1", "l2").agg(F.min("key").alias("least")))
    branches, _ = cut_to_table(branches.join(labels, ["l1", "l2"]).select("key", "h", "first", "windows", "least"))
    drop_labels()
    later = branches.where("key > least").select("key", "h", "first", "windows")
    first = _listed(branches.where("key = least"), "pieces")
    # One exchange of the texts serves the edges and the final join.
    placed = rows.repartition("key", "h")
    graph = edges(placed.join(first, ["key", "h"]), window)
    sources = graph.groupBy("e", "v").agg(
        F.min("key").alias("least"), F.max("key").alias("most"), F.min_by("at", "key").alias("source"), (F.min("beside") == F.max("beside")).alias("plain")
    )
    sources = sources.where("least < most").drop("most")
    hits = graph.join(sources, ["e", "v"]).where("key > least").select("key", "h", "first", "at", "least", "source", "plain")
    paths = compact(hits).select("key", "h", "path.first", "path.windows")
    spans = _listed(whole.unionByName(later).unionByName(paths), "spans")
    out = placed.join(spans, ["key", "h"], "left")
    return out.select(F.col("key").alias(key), F.col("text").alias(text), "spans")


def without_spans(found: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``key, n_words, n_removed, kept``: the text's words outside the spans, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "n_words", "n_removed", "kept"]
        for batch in batches:
            totals, removed, kept = [], [], []
            for row in range(batch.num_rows):
                words = (batch.column(1)[row].as_py() or "").encode().split()
                totals.append(len(words))
                spans = batch.column(2)[row]
                if spans.is_valid:
                    first, windows = (spans.values.field(n).to_numpy() for n in ("first", "windows"))
                    depth = np.bincount(first, minlength=len(words) + 1) - np.bincount(first + windows + window - 1, minlength=len(words) + 1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
                removed.append(totals[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=names
            )

    schema = T.StructType(
        [found.schema[key], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    )
    return found.select(key, text, "spans").mapInArrow(run, schema)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(ws, s, s + 49), ' ')) AS win
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS s FROM d WHERE len(ws) >= 50)),
f AS (SELECT win, min(doc_id) AS least FROM w GROUP BY win),
r AS (
  SELECT DISTINCT doc_id, unnest(generate_series(s, s + 49)) AS place
  FROM w JOIN f USING (win) WHERE least < doc_id),
k AS (
  SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.place) AS kept, count(*) AS n_kept
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS place FROM d) u
  ANTI JOIN r ON r.doc_id = u.doc_id AND r.place = u.place GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
