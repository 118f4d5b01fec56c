"""Text sources and row-wise merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.ordering import numbered


def paste(a: DataFrame, a_order: list[str], b: DataFrame, b_order: list[str]) -> DataFrame:
    """Columns of two tables side by side by row position ``r`` (from 1); rows without a partner are left out."""
    return numbered(a, a_order).join(numbered(b, b_order), "r")


NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def parse_agents(lines: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of ``value`` = ``lon lat : field field ...`` (comments start with #; empty lines are skipped).

    ``bad`` marks lines that do not parse; what cannot be read is null.
    """
    lines = lines.select(F.trim(F.regexp_replace("value", "#.*", "")).alias("line")).where("line <> ''")
    head = lambda i: F.regexp_extract("line", rf"^({NUMBER})\s+({NUMBER})\s*:", i)
    rest = F.split(F.trim(F.regexp_replace("line", r"^[^:]*:", "")), r"\s+")
    values = [F.try_element_at(rest, F.lit(i + 1)).try_cast("double").alias(f) for i, f in enumerate(fields)]
    parsed = lines.select(head(1).try_cast("double").alias("lon"), head(2).try_cast("double").alias("lat"), *values)
    missing = F.lit(False)
    for c in ("lon", "lat", *fields):
        missing = missing | F.col(c).isNull()
    return parsed.withColumn("bad", missing)


def read_agents(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """``parse_agents`` of text files (gzip is read as it is)."""
    return parse_agents(spark.read.text(path), fields)


def ped_lines(genotypes: DataFrame) -> DataFrame:
    """PLINK ``ped`` lines of ``id, gender, mom, dad, pairs`` (pairs: letters of both strands, locus by locus); sex is 2 - gender."""
    sex = (F.lit(2) - F.col("gender")).cast("string")
    return genotypes.select(F.concat_ws(" ", F.lit("F"), F.col("id").cast("string"), F.col("dad").cast("string"), F.col("mom").cast("string"), sex, F.lit("0"), "pairs").alias("value"))


def parse_ped(lines: DataFrame) -> DataFrame:
    """``id, gender, mom, dad, strand1, strand2`` (letters) of ``ped`` lines."""
    parts = F.split("value", r"\s+")
    at = lambda i: F.get(parts, F.lit(i))
    alleles = F.slice(parts, 7, F.greatest(F.size(parts) - 6, F.lit(0)))
    strand = lambda k: F.array_join(F.filter(alleles, lambda _, i: i % 2 == k), "")
    return lines.select(
        at(1).cast("bigint").alias("id"), (F.lit(2) - at(4).cast("int")).alias("gender"), at(3).cast("bigint").alias("mom"), at(2).cast("bigint").alias("dad"),
        strand(0).alias("strand1"), strand(1).alias("strand2"),
    )


def wildcard_regex(pattern: str) -> str:
    """A pattern with ``*`` (any text), ``?`` (one sign), ``#`` (digits), ``&`` (letters) as a regular expression with one group each."""
    parts = {"*": "(.*)", "?": "(.)", "#": "([0-9]+)", "&": "([A-Za-z]+)"}
    return "^" + "".join(parts.get(c) or ("\\" + c if not c.isalnum() and c != "_" else c) for c in pattern) + "$"
