"""The opN_ queries and their SQL."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, divergence, fingerprints, language, licenses, lines, packing, pii, repeats, resampling, similarity, token_files, toxicity


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op2_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), with_kept=False).drop("kept")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), "spaces", 2)


def op4_nb_linear_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), "blanks", 0)


def op6_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op7_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), with_spans=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _pii_key() -> str:
    if "PII_KEY" not in os.environ:
        warnings.warn("PII_KEY is not set: pseudonyms use a key that anyone can read in the source and undo", stacklevel=3)
    return os.environ.get("PII_KEY", "example key, replace it")


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymize(_table(spark, sf_dir, "documents"), _pii_key())
    return out.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_values"), F.array_join("pii_kinds", ",").alias("kinds"))


def op9_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_components(_table(spark, sf_dir, "documents"))


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.fuzzy_line_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("kept_text").cast("long").alias("kept_chars"), F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"), findings=False)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_iblt_fingerprints, op2_prefix_free_parsing, op3_token_files, op4_nb_linear_toxicity, op5_best_fit_packing, op6_language_fusion, op7_fm_index_decontamination, op8_feistel_pseudonyms, op9_token_group_join, op10_fuzzy_lines, op11_license_scan, op12_source_divergence, op13_importance_resampling)}
ORACLES: dict[str, str] = {"op12_source_divergence": divergence.SQL, "op13_importance_resampling": resampling.SQL}
