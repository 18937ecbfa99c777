"""Record sources and the statistics sink."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

LOG = logging.getLogger("quillet")
EVALUATION = StructType([StructField(n, StringType()) for n in ("assembly", "language", "source")])
TRAINING = StructType([*EVALUATION.fields, StructField("reasoning", StringType())])


def read_jsonl(spark: SparkSession, path: str, schema: StructType = EVALUATION) -> DataFrame:
    """One record a line; a line that is no JSON raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_lenient(spark: SparkSession, path: str, schema: StructType = EVALUATION) -> DataFrame:
    """One record a line; bytes that are no UTF-8 become replacement characters before the line is parsed."""
    lines = spark.read.text(path).select(F.make_valid_utf8("value").alias("value")).where(F.length(F.trim("value")) > 0)
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_jsonl_inferred(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of a text file."""
    return spark.read.text(path).select(F.trim("value").alias("title")).where("title != ''")


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """A statistics file with or without the count; both line ends are read."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def write_statistics(stats: DataFrame, path: str, single: bool = False) -> bool:
    """Header and rows in one file; nothing is written for no scores, which is logged. stats is an aggregate of a few rows.

    path becomes a folder that holds the file, or with single the file itself: it is written beside its place and moved there
    when it is whole, so that readers see the old file or the new one.
    """
    spark, kept = stats.sparkSession, stats.where("Count > 0")
    rows = kept.collect()  # computed once: a row a group
    if not rows:
        LOG.info("no scores, %s is not written", path)
        return False
    found = spark.createDataFrame(rows, kept.schema).coalesce(1)
    if single:
        write_single(found.write.option("header", True).csv, spark, path)
    else:
        found.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_single(write: Callable[[str], None], spark: SparkSession, path: str) -> None:
    """The one part file that write(folder) makes, moved to path.

    The folder lies beside path, so the move is a rename within one file system, which replaces an older file at once where
    the file system can (HDFS and local ones do). An interrupted write leaves the old file; the folder goes in any case.
    """
    jvm = spark._jvm  # there is no public way to Hadoop's file systems
    if jvm is None:
        raise NotImplementedError("a single file needs a session with a JVM of its own")
    hadoop = jvm.org.apache.hadoop.fs
    folder, target = f"{path}.writing-{uuid.uuid4().hex[:12]}", hadoop.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(folder)
        parts = [s.getPath() for s in files.listStatus(hadoop.Path(folder)) if s.getPath().getName().startswith("part-")]
        if len(parts) != 1:
            raise ValueError(f"{len(parts)} files were written where one was expected")
        where = hadoop.FileContext.getFileContext(target.toUri() if target.isAbsolute() and target.toUri().getScheme() else files.getUri(), spark._jsc.hadoopConfiguration())
        options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = hadoop.Options.Rename.OVERWRITE
        where.rename(parts[0], files.makeQualified(target), options)
    finally:
        files.delete(hadoop.Path(folder), True)


@dataclass
class Progress:
    """What a write has gone through: rows, and of a score its sum and mean."""

    rows: int
    total: float | None
    mean: float | None


def write_observed(df: DataFrame, write: Callable[[DataFrame], None], score: str | None = None, name: str = "rows") -> Progress:
    """write(df), with its rows counted and their scores summed while they are written: no second job reads them.

    Retried tasks count once. What was seen is logged and returned.
    """
    seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
    total = F.sum(F.col(score).cast("double")) if score else F.lit(None).cast("double")
    n = F.count(F.col(score)) if score else F.lit(0)
    write(df.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("s"), F.max(n).alias("k") if not score else n.alias("k")))
    got = seen.get
    mean = got["s"] / got["k"] if got.get("k") else None
    LOG.info("%s: %d rows%s", name, got["n"], "" if mean is None else f", mean {mean:.4f}")
    return Progress(got["n"], got["s"], mean)


def log_progress(scores: DataFrame, every: int, name: str = "scores") -> None:
    """Logs the rows and their running mean after every so many rows of scores (idx from 0, score), in order of idx."""
    batch = F.floor(F.col("idx") / every)
    sums = scores.groupBy(batch.alias("batch")).agg(F.count("*").alias("n"), F.sum("score").alias("s")).orderBy("batch")
    n, total = 0, 0.0
    for row in sums.toLocalIterator():  # one row a batch
        n, total = n + row["n"], total + row["s"]
        LOG.info("%s: %d rows, mean %.4f", name, n, total / n)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
