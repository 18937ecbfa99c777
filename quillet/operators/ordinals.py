"""An index of ordinals: rows stored once in an order, and for each file its first ordinal, so that record n opens one file."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, free_name, stored

#: monotonically_increasing_id() holds the partition above these bits and the row's place in it below.
PLACE_BITS = 33


class OrdinalIndex:
    """The rows of df along order, numbered from 0.

    Building sorts and writes the table once. `files` has a row for each file: file, first (ordinal), rows, base (the place of
    its first row). Equal keys get numbers in an order of their own that the stored layout fixes; null keys come first.
    Ordinals outside the table name no row. Columns of df may have any names.
    """

    def __init__(self, df: DataFrame, *order: str | Column) -> None:
        tie, self.place = free_name(df, "tie"), free_name(df, "place")
        dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
        self.rows = stored(dealt.drop(tie).withColumn(self.place, F.monotonically_increasing_id()), "ordered")
        self.columns = df.columns
        each = self.rows.select(F.col("_metadata.file_path").alias("file"), F.col(self.place).alias("p"))
        sizes = each.groupBy("file").agg(F.count("*").alias("rows"), F.min("p").alias("base"))
        # one row a file
        before = Window.orderBy("base").rowsBetween(Window.unboundedPreceding, -1)
        self.files = stored(sizes.select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"), "rows", "base"), "offsets")

    def count(self) -> int:
        return self.files.agg(F.sum("rows")).first()[0] or 0

    def record(self, n: int, name: str = "idx") -> DataFrame:
        """Row n with its number; no row if there is none. Only the file that holds it is opened, and there its row group."""
        at = self.files.where((F.col("first") <= n) & (F.lit(n) < F.col("first") + F.col("rows"))).first()
        found = self.rows.where("false") if at is None else self.rows.sparkSession.read.schema(self.rows.schema).parquet(at["file"]).where(F.col(self.place) == at["base"] + n - at["first"])
        return found.select(*[c for c in self.columns if c != name], F.lit(n).cast("long").alias(name))

    def records(self, begin: int, end: int, name: str = "idx") -> DataFrame:
        """Rows begin to end - 1; files and row groups outside are skipped by the bounds of their places."""
        ends = self.files.where((F.col("first") < end) & (F.lit(begin) < F.col("first") + F.col("rows")))
        bounds = ends.agg(F.min_by(F.col("base") + begin - F.col("first"), "first"), F.max_by(F.col("base") + end - F.col("first"), "first")).first()
        low, high = bounds if bounds[0] is not None else (0, 0)
        return self.numbered(name, F.col(self.place).between(low, high - 1)).where(F.col(name).between(begin, end - 1))

    def numbered(self, name: str = "idx", where: Column | None = None) -> DataFrame:
        """All rows (that satisfy a condition on their places) with their numbers."""
        file = free_name(self.rows, "file")
        rows = self.rows if where is None else self.rows.where(where)
        files = self.files.select(F.shiftright("base", PLACE_BITS).alias(file), (F.col("first") - F.col("base")).alias(file + "_from"))
        both = rows.withColumn(file, F.shiftright(self.place, PLACE_BITS)).join(files, file)
        kept = [c for c in self.columns if c != name]
        return both.select(*kept, (F.col(self.place) + F.col(file + "_from")).cast("long").alias(name))

    def shard(self, rank: int, world: int, name: str = "idx") -> DataFrame:
        """Every world-th row, from row rank on."""
        return self.numbered(name).where(F.pmod(F.col(name), F.lit(world)) == rank)

    def drop(self) -> None:
        discard(self.rows, self.files)


def with_ordinal(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """df with its rows numbered from 0 along `order`, without one task that holds all rows.

    A column of that name in df is replaced. Rows whose keys are equal get different numbers in an order of their own, so
    only unique keys make the numbers reproducible. No rows give no rows; null keys come first.
    """
    if name in df.columns and name not in order:
        df = df.drop(name)
    return OrdinalIndex(df, *order).numbered(name)


#: Up to this row a task keeps its first rows whole; beyond, the keys are put in order first.
TOP = 10_000


def nth_record(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Row n of df from 0 along order. Of rows with equal keys any may be the n-th; beyond the last row there is none.

    Far rows are found by an index of the keys alone: df is then asked for the rows with that key, so its other columns are
    neither sorted nor written. OrdinalIndex is for many such questions.
    """
    if n < TOP:
        return df.orderBy(*order).offset(n).limit(1)
    index = OrdinalIndex(df.select(*order), *order)
    key = index.record(n).first()
    index.drop()
    if key is None:
        return df.where("false")
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.lit(key[c]).cast(df.schema[c].dataType))
    return df.where(same).limit(1)


def exact_split(df: DataFrame, key: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """df with is_test: the ceil(share * n) rows of the least seeded md5 of the key. Of equal keys at the cut any may go.

    The hashes alone are put in order; the one at the cut then splits df where it is. Only rows with that very hash are
    numbered, and only if some of them must go either way. A column is_test in df is replaced.
    """
    df = df.drop("is_test")
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    index = OrdinalIndex(df.select(hashed.alias("hash")), "hash")
    cut = math.ceil(share * index.count())
    at = index.record(cut).first()
    first = index.numbered().where(F.col("hash") == at["hash"]).agg(F.min("idx")).first()[0] if at else cut
    index.drop()
    if at is None:  # all rows or none
        return df.withColumn("is_test", F.lit(cut > 0))
    if first == cut:
        return df.withColumn("is_test", hashed < at["hash"])
    place = free_name(df, "place")
    tied = with_ordinal(df.where(hashed == at["hash"]), key, name=place)
    tied = tied.withColumn("is_test", F.col(place) < cut - first).drop(place)
    return df.where(hashed != at["hash"]).withColumn("is_test", hashed < at["hash"]).unionByName(tied)
