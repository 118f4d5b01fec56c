"""Thin queries over the operators of this subpackage: one ``opN_<name>`` for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import decontamination, html_text, mixing, quality, secrets, simhash, substring_dedup, token_counts, toxicity, transport_stream

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table. One of texts that has fewer files than the cluster has cores (a single row group is a single
    task) is dealt out to all cores first; tables of many files are read as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages") and len(df.inputFiles()) < cores:
        df = df.repartition(cores)
    return df


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text under the byte-level BPE of 50k entries."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.html_text(table(spark, sf_dir, "pages"))


def op3_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an MPEG transport stream and read back."""
    found = transport_stream.read_streams(transport_stream.store_streams(table(spark, sf_dir, "documents")))
    feature = F.concat_ws(
        ":",
        F.col("programs").cast("string"),
        F.col("packets").cast("string"),
        F.col("units").cast("string"),
        F.element_at("pts", -1).cast("string"),
        F.array_join(F.transform("random_access", lambda x: x.cast("string")), "."),
        F.col("discontinuities").cast("string"),
        F.col("error"),
    )
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature")
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1 of their sources."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those within two bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: counts by kind and digests of the base spans and of all spans."""
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "entropy")), 256)
    return found.select("doc_id", of("assign"), of("access"), of("hex"), base.alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold windows of benchmark items."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text that no smaller document's 50-word window repeats."""
    found = substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    kept = substring_dedup.without_spans(found)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text by a factorisation machine."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, deobfuscated."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_html_text": op2_html_text,
    "op3_transport_streams": op3_transport_streams,
    "op4_mix_sources": op4_mix_sources,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_decontamination": op7_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL: dict[str, str] = {
    "op7_decontamination": decontamination.ORACLE_SQL,
    "op8_substring_dedup": substring_dedup.ORACLE_SQL,
}
