"""Dominance counting: for every row, the rows of an equal or earlier slot whose level is strictly higher, and their weight.

All rows stand in one order, slots ascending and levels descending within a slot: what is above a row then always stands
before it. Ranges of that order are the shards, so a slot that holds any share of the rows is split like all others. Within
a shard a merge-sort tree over the places answers "how many of the first p places have a level above l" by one binary search
at the root and a descent along stored positions (fractional cascading); nodes hold weighted suffix sums.

What complete earlier shards hold is a second problem of the same kind: in the order of levels descending, shards descending
within a level, the rows wanted stand before a row and have a smaller shard. Ranges of that order are blocks, counted by the
same tree within, and by a table of the totals of every block and shard across. There are as many blocks as shards, at most
the square root of the rows of each, so that this table never has more rows than the input. Nothing is collected or
broadcast by this module: the totals are summed by windows of one shard or one block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import discard, free_name, stored

#: Rows of a shard, about; a shard is held by one task.
SHARD_ROWS = 1 << 17


class MergeSortTree:
    """Over places 0..m-1 with values and weights; node j of height h covers the 2**h places from j * 2**h on.

    Each height is one array of all its nodes, the values of a node ascending. `lefts` counts, before each entry, those of
    the height's entries that come from left children: the difference to a node's start leads from a rank in the node to
    the rank in either child. `sums` are weights before each entry.
    """

    def __init__(self, values: np.ndarray, weights: np.ndarray):
        self.m, self.height = len(values), int(len(values)).bit_length()
        place = np.argsort(values, kind="stable")
        self.sorted = values[place]
        self.lefts, self.sums = [], []
        for h in range(self.height - 1, -1, -1):
            left = (place >> h) & 1 == 0
            before = np.zeros(self.m + 1, np.int64)
            np.cumsum(left, out=before[1:])
            start = place >> (h + 1) << (h + 1)
            into = np.where(left, start + before[:-1] - before[start], start + self._half(start, h) + np.arange(self.m) - start - before[:-1] + before[start])
            down = np.empty_like(place)
            down[into] = place
            place = down
            sums = np.zeros(self.m + 1, np.int64)
            np.cumsum(weights[place], out=sums[1:])
            self.lefts.append(before.astype(np.int32))
            self.sums.append(sums)

    def _half(self, start: np.ndarray, h: int) -> np.ndarray:
        """Places of the left child of the node of height h + 1 that begins at start."""
        return np.clip(self.m - start, 0, 1 << h)

    def above(self, places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query, number and weight of the first `places` places that hold more than `values`."""
        rank = np.searchsorted(self.sorted, values, side="right")
        count, weight = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        for h, before, sums in zip(range(self.height - 1, -1, -1), self.lefts, self.sums, strict=True):
            start = places >> (h + 1) << (h + 1)
            in_left = before[start + rank] - before[start]
            right = (places >> h) & 1 == 1
            half = self._half(start, h)
            # the left child is complete: its suffix above the value counts
            count += np.where(right, half - in_left, 0)
            weight += np.where(right, sums[start + half] - sums[start + in_left], 0)
            rank = np.where(right, rank - in_left, in_left)
        return count, weight


def _counted(ordered: DataFrame, part: str, value: str, sign: int, weight: str, count: str, total: str) -> DataFrame:
    """ordered, whose partitions are numbered by `part`, with count and total added to: what stands before a row in its
    partition with a larger sign * value."""
    schema = StructType([*(f for f in ordered.schema.fields if f.name not in (count, total)), StructField(count, LongType()), StructField(total, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        of = lambda name: rows[name].to_numpy()
        values = of(value).astype(np.int64) * sign
        n, w = MergeSortTree(values, of(weight).astype(np.int64)).above(np.arange(len(values)), values)
        if count in rows.column_names:
            n, w = n + of(count), w + of(total)
            rows = rows.drop_columns([count, total])
        rows = rows.append_column(count, pa.array(n)).append_column(total, pa.array(w))
        yield from rows.combine_chunks().to_batches(max_chunksize=20_000)

    return ordered.mapInArrow(run, schema)


def _across(cells: DataFrame, blocks: int) -> DataFrame:
    """cells (block, shard, n, w) -> (block, shard, n, w) of every cell: sums over all earlier blocks and smaller shards."""
    by_shard = Window.partitionBy("shard").orderBy("block")
    upto = by_shard.rowsBetween(Window.unboundedPreceding, 0)
    last = F.least(F.coalesce(F.lead("block").over(by_shard), F.lit(blocks - 1)), F.lit(blocks - 1))
    sums = cells.select("shard", F.sum("n").over(upto).alias("n"), F.sum("w").over(upto).alias("w"), (F.col("block") + 1).alias("a"), last.alias("b"))
    # a shard's sum so far stands at every block up to its next cell
    carried = sums.where("a <= b").select(F.explode(F.sequence("a", "b")).alias("block"), "shard", "n", "w", F.lit(False).alias("asked"))
    asked = cells.select("block", "shard", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("w"), F.lit(True).alias("asked"))
    smaller = Window.partitionBy("block").orderBy("shard").rangeBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(smaller), F.lit(0)).alias(c) for c in ("n", "w")]
    return carried.unionAll(asked).select("block", "shard", "asked", *sums).where("asked").drop("asked")


def dominance_counts(rows: DataFrame, slot: str, level: str, weight: str, count: str = "n_above", total: str = "w_above", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """rows with count and total: the number and the summed weight of the rows with slot <= its slot and level > its level.

    slot, level and weight are integers; the rows carry whatever other columns they have through two exchanges. A row whose
    slot or level is null is above none and its counts are null; a null weight counts as 0. Equal rows are rows of their
    own and never above each other; columns named count or total are replaced; no rows give no rows.
    """
    rows = rows.drop(count, total)
    whole = F.col(slot).isNotNull() & F.col(level).isNotNull()
    nulls = rows.where(~whole).select("*", F.lit(None).cast("long").alias(count), F.lit(None).cast("long").alias(total))
    names: dict[str, str] = {}
    for n in ("tie", "shard", "block", "load"):
        names[n] = free_name(rows, f"{n}_of")
    tie, shard, block, load = names.values()
    points = rows.where(whole).withColumn(load, F.coalesce(F.col(weight), F.lit(0)).cast("long")).withColumn(tie, F.monotonically_increasing_id())
    n = points.count()
    pieces = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // shard_rows))
    pieces = max(1, min(pieces, math.isqrt(n)))
    part = F.spark_partition_id().cast(IntegerType())

    def ordered(df: DataFrame, name: str, *order: Column) -> DataFrame:
        return df.repartitionByRange(pieces, *order, F.col(tie)).sortWithinPartitions(*order, F.col(tie)).withColumn(name, part)

    by_slot = stored(_counted(ordered(points, shard, F.col(slot), F.desc(level)), shard, level, 1, load, count, total), "shards")
    by_level = stored(_counted(ordered(by_slot, block, F.desc(level), F.desc(shard)), block, shard, -1, load, count, total), "blocks")
    discard(by_slot)
    cells = by_level.groupBy(F.col(block).alias("block"), F.col(shard).alias("shard")).agg(F.count("*").alias("n"), F.sum(load).alias("w"))
    across = stored(_across(cells, pieces), "across").select(F.col("block").alias(block), F.col("shard").alias(shard), F.col("n").alias(tie), F.col("w").alias(load))
    found = by_level.drop(tie, load).join(across, [block, shard])
    sums = [(F.col(count) + F.col(tie)).alias(count), (F.col(total) + F.col(load)).alias(total)]
    return found.select(*rows.columns, *sums).unionAll(nulls.select(*rows.columns, count, total))


def hour_slot(df: DataFrame, name: str) -> Column:
    """Hours since 1970 of a timestamp; one without a zone is taken as UTC, whatever the session's zone."""
    if df.schema[name].dataType.typeName() == "timestamp":
        return F.floor(F.unix_seconds(name) / 3600).cast("long")
    return (F.datediff(F.to_date(name), F.lit("1970-01-01").cast("date")) * 24 + F.hour(name)).cast("long")


def sale_points(sales: DataFrame) -> DataFrame:
    """sales (sale_id, total, sold_at) -> sale_id, slot, level, weight.

    A null or non-finite total has no level; a null sale_id stands for one row, as the checksum of an empty text is 0.
    """
    total = F.when(F.abs("total") < F.lit(float("inf")), F.col("total"))
    level = F.floor(F.floor(100 * total + 0.5) / F.lit(100.0)).cast("long")
    weight = 1 + F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit(""))) % 2
    return sales.select("sale_id", hour_slot(sales, "sold_at").alias("slot"), level.alias("level"), weight.cast("long").alias("weight"))
