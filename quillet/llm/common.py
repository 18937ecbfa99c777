"""Shared pieces: table access, word splitting, binding of intermediate values, and tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, free_name, fresh_path, stored, work_dir

__all__ = ["SPACE_CHARS", "SPACE_RE", "UPPER", "ascii_lower", "discard", "free_name", "fresh_path", "join_by_hot_key", "let", "stored", "table", "text_of", "words_of", "work_dir"]

#: White space as the contracts define it: space and U+0009 to U+000D.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a non-null text: maximal runs of anything but white space."""
    return F.array_remove(F.split(text, SPACE_RE), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Texts of one byte a character take the fast built-in path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def join_by_hot_key(big: DataFrame, small: DataFrame, key: str, share: float = 1e-3) -> DataFrame:
    """Inner join of big with small, whose keys are distinct. The rows of keys that hold more than `share` of big, which are
    at most 1 / share, meet a broadcast part of small where they are; only the others are dealt out by key."""
    total = big.count()
    hot = stored(big.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > share * total).select(key), "hot_keys")
    few = stored(small.join(F.broadcast(hot), key, "left_semi"), "hot_rows")
    return big.join(F.broadcast(few), key).unionByName(big.join(F.broadcast(hot), key, "left_anti").join(small, key))
