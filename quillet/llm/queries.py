"""The registered queries: thin wrappers that derive each contract's columns from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, dominance, extract, langid, linedup, merkle, mixing, pii, pst, quality, simhash, tokens, urls
from .common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), bits=4, words_per_shingle=4).select("doc_id", "fingerprint", "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return pst.score_documents(table(spark, sf_dir, "documents")).select(*columns)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linedup.removed_spans(table(spark, sf_dir, "documents"), whole_lines=5)
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", "n_words", "removed_words", F.array_min("sources").alias("first_source"), spans.alias("spans"))


def op8_weighted_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"]
    return quality.quality_verdicts(table(spark, sf_dir, "documents")).select(*columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near", "near_sha256")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.document_manifest(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op13_dominance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dominance.dominance_counts(dominance.sale_points(table(spark, sf_dir, "sales")), "slot", "level", "weight", "n_sales", "n_rows")
    return found.select("sale_id", "slot", "level", "n_sales", "n_rows")


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_pii, op3_url_filters, op4_suffix_tree_scores, op5_language_id, op6_token_files, op7_line_dedup, op8_weighted_mixing, op9_quality_rules, op10_decontamination, op11_merkle_manifest, op12_html_extraction, op13_dominance_counts)}
