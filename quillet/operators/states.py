"""Statistics as partial states: written by shard, merged without reading the shards' scores again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def states(scores: DataFrame, score: str, by: str) -> DataFrame:
    """(by, n, mean, m2, least, most) of each group; groups without scores have no state."""
    x = F.col(score).cast("double")
    return scores.groupBy(by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"), F.min(x).alias("least"), F.max(x).alias("most")).where("n > 0")


def write_shard(scores: DataFrame, score: str, by: str, path: str, shard: str) -> None:
    """The states of a shard's scores under path; a shard that is written again replaces what it wrote."""
    states(scores, score, by).write.mode("overwrite").parquet(f"{path}/shard={shard}")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(parts: DataFrame, by: str) -> DataFrame:
    """Partial states of any number of shards as one state a group: squares about the joint mean, so nothing cancels."""
    group = Window.partitionBy(by)
    mean = F.sum(F.col("n") * F.col("mean")).over(group) / F.sum("n").over(group)
    moved = parts.withColumn("joint", mean)
    squares = F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("joint"), 2))
    return moved.groupBy(by).agg(F.sum("n").alias("n"), F.first("joint").alias("mean"), squares.alias("m2"), F.min("least").alias("least"), F.max("most").alias("most"))


def as_statistics(state: DataFrame, by: str) -> DataFrame:
    """The columns of stats.statistics(): sample standard deviation, 0 for one score."""
    deviation = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).otherwise(0.0)
    return state.select(by, F.col("least").alias("Min"), F.col("most").alias("Max"), F.col("mean").alias("Average"), deviation.alias("Standard_Deviation"), F.col("n").alias("Count"))
