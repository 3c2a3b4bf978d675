"""The corpus queries: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe as _bpe
from plumbline.llm import chunk_dedup, jaccard_join, language_id, mixing, quality, secret_scan, suffix_dedup, urls, vector_search
from plumbline.llm.oracles import ORACLES  # noqa: F401  for the registry
from plumbline.llm.shared import arrow_limits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, table(spark, sf_dir, "documents"))


def encoded(spark: SparkSession, docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    arrow_limits(spark)
    both = _bpe.bpe(spark, _bpe.load_ranks(public_tokenizers.path(vocabulary)), public_tokenizers.PATTERN)[2]
    out = docs.select("doc_id", both(F.col("text")).alias("t")).select("doc_id", F.col("t.ids").alias("ids"), F.col("t.decoded").alias("decoded"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _bpe.ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(chunk_dedup.chunk_dedup(table(spark, sf_dir, "documents"), extend=True))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")))


def _digested(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op10_vantage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in secret_scan.KINDS],
        F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def op9_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_quality(table(spark, sf_dir, "documents")).select("doc_id", "quality.*")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op2 doesn't depend on the order of documents."""
    return op2_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op8's base kinds."""
    return op8_secret_scan(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in secret_scan.KINDS])


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's base columns."""
    return op9_repetition_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def exact_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 by its exact factor, scores to 9 places."""
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), factor=1.0).withColumn("score", F.round("score", 9))


QUERIES = {f.__name__: f for f in (exact_neighbours, mix_targets, secret_counts, quality_base, op1_byte_bpe, op2_mix_sources, op3_chunk_dedup, op4_suffix_dedup, op5_jaccard_join, op6_language_id, op7_url_reputation, op8_secret_scan, op9_repetition_quality, op10_vantage_search)}
