"""A bounded, reproducible sample of labelled rows to fit classifiers on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.lineage import cut

#: Fold that is never learned from.
FOLDS, HELD_OUT_FOLD = 5, 0
#: Bytes of features that a fit takes at most, whatever the lengths of the labelled texts.
TRAIN_BYTES = 96 << 20


def held_out(key: str) -> Column:
    """Whether crc32 of the key as text is 0 modulo 5; null keys are held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == HELD_OUT_FOLD, F.lit(True))


def sample_keys(labels: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """``key, y`` of at most ``most`` labelled keys outside the held-out fold: those of least hash.

    A key with several labels takes the larger one; null keys and labels are left out.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
    known = known.groupBy(key).agg(F.max(label).cast("int").alias("y"))
    return known.orderBy(F.xxhash64(key), key).limit(most)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, most: int) -> DataFrame:
    """``key, text, y``: one row for each of the sampled keys that ``docs`` has, however many rows share it (of several
    texts the one of least hash). The sample (at most ``most`` rows of 12 bytes) is broadcast."""
    known = docs.select(key, text).join(F.broadcast(sample_keys(labels, label, key, most)), key)
    return known.groupBy(key).agg(F.min_by(text, F.xxhash64(text)).alias(text), F.max("y").alias("y"))


def bounded_rows(rows: DataFrame, key: str, blobs: list[str], most_bytes: int = TRAIN_BYTES) -> pd.DataFrame:
    """At most ``most_bytes`` of ``rows`` (already bounded in number), of least hash of their key, at the driver.

    Texts may be of any length, and so may their features: sizes are looked at first (a few bytes a
    row), and rows beyond the bound stay on the executors.
    """
    rows = cut(rows)
    size = sum((F.length(b) for b in blobs), F.lit(0)).cast("bigint")
    sizes = rows.select(F.xxhash64(key).alias("h"), size.alias("n")).toPandas().sort_values(["h", "n"], kind="stable")
    kept = sizes["h"][sizes["n"].cumsum() <= most_bytes]
    if len(kept) < len(sizes):
        first_left_out = int(sizes["h"].iloc[len(kept)])
        rows = rows.where(F.xxhash64(key) < first_left_out)
    return rows.toPandas()
