"""A training-corpus pipeline: five stages over ``documents``, each written as Parquet and reread.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of ``docs``. Each works on all rows its predecessor kept:

1. quality: documents that the factorisation machine rejects go;
2. near_duplicates: of each SimHash component the document with the smallest id stays (of different
   texts with that id the one of least digest; of rows that agree in both the one of least hash of
   the other columns, once), a null id only where no other is;
3. decontaminate: contaminated documents go, row by row (ids may be null or repeated);
4. secrets: spans of secrets are replaced by a mark, ``n_chars`` follows; no document goes;
5. mix: copies of each document for the target mix of sources.

Defined results: null, empty and very long texts are judged like any other by each operator (a null
text as the empty one); null ids are ids of their own kind and pass, repeated rows pass all stages
but near_duplicates; null sources are a source; further columns pass through, whatever their names,
and are not read; an empty table gives no rows. Reruns agree.

``ORACLE_SQL`` is None: the fitted classifier, 64-bit SimHash components, entropy spans and the
pivotal draw have no DuckDB form; ``tests/llm/test_pipeline.py`` holds the stages against
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.lineage import cut_to_table
from cohortspark.llm import decontamination, mixing, quality, secrets, simhash
from cohortspark.llm.queries import table


def packed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns, so that no name can clash), ``text``, ``row_key`` and ``rest``.

    Rows that share ``row_key`` have the same id and text: the id and a digest of the text, ids in
    their order and nulls last. ``rest`` is a hash of the other columns.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    others = [F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.coalesce(F.md5("text"), F.lit("")).alias("digest"))
    return docs.select(F.struct(*own).alias("row"), F.col("text").alias("text"), key.alias("row_key"), F.xxhash64(F.lit(0), *others).alias("rest"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    return unpacked(quality.quality_scores(packed(docs).select("row", "text"), machine, ["row"]).where("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text counts by itself: ids may be null or repeated; a null id stays where its component has no other."""
    rows = packed(docs)
    first = simhash.near_duplicates(rows.select("row_key", "text"), "row_key").where("row_key = component_id").select("row_key").distinct()
    least = rows.groupBy("row_key").agg(F.min("rest").alias("rest"))
    chosen = first.join(least, "row_key")
    return unpacked(rows.join(chosen, ["row_key", "rest"], "left_semi").dropDuplicates(["row_key"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text counts by itself: a clean one stays whatever else has its id."""
    rows = packed(docs)
    found = decontamination.contamination(rows.select("row_key", "text"), table(spark, sf_dir, "benchmark"), "row_key")
    bad = found.where("contaminated").select("row_key").distinct()
    return unpacked(rows.join(bad, "row_key", "left_anti"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("mix", mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``.

    Stages are written to the shared folder; each table goes when the next one is written, the
    last one when the program ends.
    """
    docs, drop = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, drop_this = cut_to_table(stage(spark, docs, sf_dir))
        if drop is not None:
            drop()
        drop = drop_this
    return docs
