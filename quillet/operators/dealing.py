"""Rows dealt out by a key into partitions of about one size, for work that makes many rows of each text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters a partition. A character of text makes some hundred bytes of tokens or n-grams to sort; tables of texts have far larger partitions.
PART_CHARS = 1 << 20


def dealt(df: DataFrame, key: str, text: Column, part_chars: int = PART_CHARS) -> DataFrame:
    """df dealt out by key, in a number of partitions that grows with the characters of its texts.

    The characters are summed first, when the plan is made, in a pass of its own. Adaptive execution leaves a number that was
    asked for as it is, so a task's memory stays the same however large the table is. Rows of one key stay together.
    """
    total = df.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    return df.repartition(max(2, total // part_chars + 1), key)
