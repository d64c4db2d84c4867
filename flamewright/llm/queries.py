"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import attention, bagminhash, cws, mixing, packing, pii, quality, secrets, spans, suffixes, token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.compare_with_next(_documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(_documents(spark, sf_dir))
    base = F.concat(*[F.col(f"pii.{k}") for k in pii.KINDS[:4]])
    counts = [F.size(f"pii.{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS[:4]]
    sums = [F.size(base).cast("long").alias("n_base"), (F.size("pii_spans") - F.size(base)).cast("long").alias("n_term")]
    return found.select("doc_id", *counts, spans.digest(base).alias("base_sha256"), spans.joined(F.col("pii_spans")).alias("spans"), *sums)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(_documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_path())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop")
    return quality.judge(_documents(spark, sf_dir)).select(*cols)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.score(_documents(spark, sf_dir), tokenizer_path())


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_classes(_documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_documents(spark, sf_dir)).drop("kept", "spans")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_documents(spark, sf_dir))
    base = secrets.in_order(F.concat(*[F.col(f"secrets.{k}") for k in secrets.KINDS[:3]]))
    counts = [F.size(f"secrets.{k}").cast("long").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, spans.digest(base).alias("base_sha256"), spans.joined(F.col("secret_spans")).alias("spans"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = token_counts.token_blocks(_documents(spark, sf_dir), tokenizer_path())
    return token_counts.scan(blocks, with_tail=False).select("doc_id", "n_tokens")


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_pii, op3_mixing, op4_best_fit_packing, op5_quality_rules, op6_lm_scoring, op7_near_dedup, op8_suffix_dedup, op9_secret_scan, op10_token_counts)}
ORACLES = {"op5_quality_rules": quality.oracle()}
