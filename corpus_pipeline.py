"""The corpus pipeline: documents in, token files out, through five of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillet.llm import decontam, mixing, quality, simhash, tokens
from quillet.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and lines above the limits go from the others.

    All stages: extra columns pass through, repeated rows are handled one by one, texts of any length are taken whole, and no
    rows give no rows. Here null and empty texts go, as they have too few words; a null source is a host of its own."""
    return quality.clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (by shingles of five words) stays, the one with the least doc_id, a null one last."""
    return simhash.keep_one_per_group(docs, words_per_shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; with an empty benchmark all stay, as do null and empty texts."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all (null and empty texts never are), once or twice."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all that is left, and the table read back from them; a null text holds the end id alone."""
    return tokens.token_table(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: SimHash components and byte-level BPE are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
