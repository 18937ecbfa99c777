"""The same scoring on a stream: running statistics by language. An extra beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_score_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def windowed_statistics(scores: DataFrame, ts: str = "ts", by: str = "language", score: str = "score", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Statistics by event-time window; rows later than the watermark are dropped."""
    x = F.col(score)
    grouped = scores.withWatermark(ts, late).groupBy(F.window(ts, window).alias("window"), by)
    return grouped.agg(F.min(x).alias("Min"), F.max(x).alias("Max"), F.avg(x).alias("Average"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("Standard_Deviation"), F.count(x).alias("Count"))
