"""Pair tables (pair_id, refs, hyp) from the provided tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


TURN_BITS = 20


def pair_number() -> Column:
    """One number for conv_id and turn. Where they don't fit side by side the plan raises, so that no two pairs are pooled."""
    conv, turn = F.col("conv_id"), F.col("turn")
    fits = turn.between(0, (1 << TURN_BITS) - 1) & (F.abs(conv) < F.lit(1 << (62 - TURN_BITS)))
    return F.when(fits | conv.isNull() | turn.isNull(), conv * (1 << TURN_BITS) + turn).otherwise(F.raise_error(F.lit("a turn or conversation number is too large")).cast("long"))


def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference: a user turn; hypothesis: the assistant turn right after it."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    w = Window.partitionBy("conv_id").orderBy("turn")
    after = turns.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("r2"), F.lead("text").over(w).alias("t2"))
    return after.where("role = 'user' and r2 = 'assistant'").select(pair_number().alias("pair_id"), F.array("text").alias("refs"), F.col("t2").alias("hyp"))


def history_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References: all earlier user turns of an assistant turn."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    earlier = turns.withColumn("refs", F.collect_list(F.when(F.col("role") == "user", F.col("text"))).over(w))
    return earlier.where("role = 'assistant' and size(refs) > 0").select(pair_number().alias("pair_id"), "refs", F.col("text").alias("hyp"))


def evaluate(records: DataFrame, language: str, weights: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25)) -> DataFrame:
    """records (record_id, language, source, response) -> scores (record_id, language, score) of the rows in that language."""
    from ..functions.text import fenced_block
    from ..operators.routing import route
    from ..operators.scores import composite

    own = records.where(route(F.col("language")) == language)
    pairs = own.select(F.col("record_id").alias("pair_id"), F.array("source").alias("refs"), fenced_block(F.col("response"), F.col("language")).alias("hyp"))
    return composite(pairs, language, weights).select(F.col("pair_id").alias("record_id"), F.lit(language).alias("language"), F.col("codebleu").alias("score"))
