"""Score statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("Min", "Max", "Average", "Standard_Deviation", "Count")


def _aggregates(score: str) -> list:
    x = F.col(score)
    return [F.min(x).alias("Min"), F.max(x).alias("Max"), F.avg(x).alias("Average"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("Standard_Deviation"), F.count(x).alias("Count")]


def statistics(scores: DataFrame, score: str = "score", by: str | None = None) -> DataFrame:
    """Min, max, mean, sample standard deviation (0 for one score) and count; groups without scores are left out."""
    grouped = scores.groupBy(by) if by else scores.groupBy()
    return grouped.agg(*_aggregates(score)).where("Count > 0")


def statistics_rollup(scores: DataFrame, by: str, score: str = "score") -> DataFrame:
    """statistics() of each group and, where `by` is null and is_total true, of all."""
    out = scores.rollup(by).agg(*_aggregates(score), F.grouping(by).alias("g"))
    return out.where("Count > 0").withColumn("is_total", F.col("g") == 1).drop("g")
