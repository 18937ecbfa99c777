"""Routing, sharding and batch numbers; ordinals and exact splits by way of operators.ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinals import PLACE_BITS, OrdinalIndex, exact_split, nth_record, with_ordinal

__all__ = ["PLACE_BITS", "OrdinalIndex", "batch_number", "exact_split", "nth_record", "route", "shard", "with_ordinal"]


def route(language: Column) -> Column:
    """The scored language of a row, or null."""
    return F.when(F.lower(language).isin("dart", "swift"), F.lower(language))


def shard(df: DataFrame, rank: int, world: int, idx: str = "idx") -> DataFrame:
    return df.where(F.pmod(F.col(idx), F.lit(world)) == rank)


def batch_number(idx: Column, size: int = 4) -> Column:
    return F.floor(idx / size).cast("long")
