"""Sentence BLEU with uniform weights and length-dependent smoothing (Chen and Cherry 2014, method 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .multiset import clipped_items, gram_items, tokenised

SMOOTHING_K = 5.0


def closest_length(h: Column, rs: Column) -> Column:
    """Tokens of the reference whose length is closest to the hypothesis's, the shorter on a tie; 0 without references."""
    near = F.array_min(F.transform(rs, lambda r: F.struct(F.abs(F.size(r) - h).alias("d"), F.size(r).alias("r"))))
    return F.coalesce(near["r"], F.lit(0))


def brevity(h: Column, r: Column) -> Column:
    """Penalty of a hypothesis of h tokens against a reference of r: 1 if longer, 0 if empty."""
    return F.when(h > r, 1.0).when(h == 0, 0.0).otherwise(F.exp(1 - r / F.greatest(h, F.lit(1))))


def sized(pairs: DataFrame, *more: Column) -> DataFrame:
    """tokenised() with n_h and n_r, the lengths that the penalty compares."""
    tokens = tokenised(pairs, *more)
    names = [c for c in tokens.columns if c not in ("pair_id", "h", "rs")]
    n_h = F.size("h")
    return tokens.select("pair_id", "h", "rs", n_h.alias("n_h"), closest_length(n_h, F.col("rs")).alias("n_r"), *names)


def order_sums(order: int) -> list[Column]:
    """Aggregates over clipped_items(): num_n and den_n of every order."""
    of = lambda n, c: F.coalesce(F.sum(F.when(F.col("kind") == n, F.col(c))), F.lit(0))
    return [x for n in range(1, order + 1) for x in (of(n, "common").alias(f"num_{n}"), of(n, "n").alias(f"den_{n}"))]


def bleu_of(order: int) -> Column:
    """The score of a row with n_h, n_r and the sums of order_sums()."""
    h, zeros, logs = F.col("n_h"), F.lit(0), F.lit(0.0)
    for n in range(1, order + 1):
        num = F.col(f"num_{n}").cast("double")
        den = F.greatest(F.col(f"den_{n}"), F.lit(1)).cast("double")
        zeros = zeros + F.when(num == 0, 1).otherwise(0)
        smooth = F.ln(F.greatest(h, F.lit(2)).cast("double")) / (F.pow(F.lit(2.0), zeros) * SMOOTHING_K)
        p = F.when(num > 0, num / den).when(h > 1, smooth / den).otherwise(0.0)
        logs = logs + F.when(p > 0, F.ln(F.when(p > 0, p).otherwise(1.0)) / order).otherwise(0.0)
    return F.when((h == 0) | (F.col("num_1") == 0), 0.0).otherwise(brevity(h, F.col("n_r")) * F.exp(logs))


def bleu(pairs: DataFrame, order: int = 4) -> DataFrame:
    """(pair_id, value). An empty hypothesis, or one without a common token, scores 0."""
    found = clipped_items(sized(pairs), gram_items(order), ("n_h", "n_r"))
    return found.groupBy("pair_id", "n_h", "n_r").agg(*order_sums(order)).select("pair_id", bleu_of(order).alias("value"))


def brevity_penalty(pairs: DataFrame) -> DataFrame:
    """(pair_id, n_h, n_r, value)."""
    return sized(pairs).select("pair_id", "n_h", "n_r", brevity(F.col("n_h"), F.col("n_r")).alias("value"))
