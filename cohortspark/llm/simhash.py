"""SimHash near-duplicates by multi-index hashing.

A fingerprint has one bit for each of 64 that is set in over half the XXH64 values (seed 42) of
the text's three-word shingles. Two tables index its halves. For two fingerprints within two bits,
either the high halves differ in at most one bit or the low halves are equal; so each fingerprint
enumerates the Hamming ball of radius 1 around its high half (33 keys) and of radius 0 around its
low half, fetches the matches of each key from the tables, and complete distances are verified.

Equal fingerprints are one entry of the index. A table entry that more than ``HOT_BUCKET``
fingerprints share is not expanded into pairs: all that probe it or are in it are indexed by the
balls of both halves at once (each half's radius-1 ball, the other half held), where entries are
proven to be within two bits and one link to the least of each entry is enough. So rows stay
proportional to the number of fingerprints, and no link between different texts is lost: the
result is the exact components of the link graph.

Defined results: a null or wordless text has fingerprint zero, linked like any other; repeated
rows give repeated rows; a null key is passed through and never becomes a component's id while
another key is in it; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.lineage import cut
from cohortspark.operators.components import connected_components

SEED = 42
SHINGLE = 3
HOT_BUCKET = 32
#: Shingles whose bits are summed at once.
_CHUNK = 1 << 15
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned fingerprint of a whole text; long texts are summed in chunks of shingles."""
    # bytes.split() takes exactly the six ASCII space characters; only A-Z are lowered.
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    shingles = (
        [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    )
    digest = xxhash.xxh64_intdigest
    values = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), _CHUNK):
        bits = np.unpackbits(values[at : at + _CHUNK, None].view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``key, fp`` of every row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), size) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, T.StructType([docs.schema[key], T.StructField("fp", T.LongType())]))


def links(points: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """``src, dst``: links that span the same components as all pairs of ``fp`` within two bits.

    ``points`` has distinct ``fp``. Every returned link is verified to be within two bits.
    """
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    zero = F.lit(0).cast("bigint")
    flips = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i))
    ball = F.concat(F.array(zero), flips)
    # Table number and key in one long: the high half's table is odd.
    entries = points.select("fp", F.explode(F.array(high * 2 + 1, low * 2)).alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("held"))
    hot = cut(sizes.where(F.col("held") > hot_bucket).select("key"))
    probes = points.select(
        "fp", F.explode(F.concat(F.transform(ball, lambda b: high.bitwiseXOR(b) * 2 + 1), F.array(low * 2))).alias("key")
    )
    far = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    any_hot = hot.limit(1).count() > 0
    cold = entries.join(hot, "key", "left_anti") if any_hot else entries
    matches = probes.join(cold.withColumnRenamed("fp", "other"), "key").where(F.col("fp") != F.col("other"))
    found = matches.where(far("fp", "other") <= 2).select(F.col("fp").alias("src"), F.col("other").alias("dst"))
    if not any_hot:
        return found
    crowd = probes.join(hot, "key", "left_semi").select("fp").distinct()
    both = F.concat(
        F.array(F.col("fp")),
        F.transform(flips, lambda b: F.col("fp").bitwiseXOR(b)),
        F.transform(flips, lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", b, F.lit(32)))),
    )
    around = crowd.select("fp", F.explode(both).alias("key"))
    centre = around.groupBy("key").agg(F.min("fp").alias("least"), F.max("fp").alias("most"))
    stars = around.join(centre.where("least < most").select("key", "least"), "key").where("fp <> least and bit_count(fp ^ least) <= 2")
    return found.unionByName(stars.select(F.col("least").alias("src"), F.col("fp").alias("dst")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``key, fingerprint, component_id`` of every row."""
    marked = cut(fingerprints(docs, key, text, size))
    points = cut(marked.groupBy("fp").agg(F.min(key).alias("least_key")))
    parts = connected_components(links(points.select("fp")), "src", "dst")
    parts = parts.join(points.withColumnRenamed("fp", "node"), "node")
    least = parts.groupBy("component").agg(F.min("least_key").alias("component_id"))
    linked = parts.join(least, "component").select(F.col("node").alias("fp"), "component_id")
    # A table of its own: the last join reads two plain exchanges, which adaptive execution splits where a fingerprint is hot.
    ids = cut(points.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least_key").alias("component_id")))
    return marked.join(ids, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
