"""Batches of rows: packed by length where the rows are, and a user's function over them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..sources.shared import free_name

SIZE = 4
#: Bytes of rows whose answers map_batches() keeps before it hands them on.
HELD_BYTES = 1 << 20
#: What set-up functions have returned in this worker process, by the call of map_batches() that they belong to.
_READY: dict[str, Callable] = {}
Batch = dict[str, list]


def packed(df: DataFrame, length: Column, size: int = SIZE) -> DataFrame:
    """df in batches of `size`: (part, batch, n, longest, padding, rows), a row a batch.

    Within each partition the rows are sorted by length (null counts as 0), so that a batch holds rows of about one length,
    and cut into batches; what is left at its end is a batch of fewer. No row moves to another partition. rows is an array of
    structs of df's columns; padding is what it takes to bring all to the longest.
    """
    size_of = free_name(df, "length")
    ordered = df.withColumn(size_of, F.coalesce(length, F.lit(0)).cast("long")).sortWithinPartitions(size_of).withColumn(part := free_name(df, "part"), F.spark_partition_id())
    kept = [f.name for f in df.schema.fields]
    schema = StructType([StructField("part", IntegerType()), StructField("batch", LongType()), StructField("n", LongType()), StructField("longest", LongType()), StructField("padding", LongType()), StructField("rows", ArrayType(df.schema, False))])

    def cut(rows: pa.Table, first: int) -> pa.RecordBatch:
        """rows, a multiple of size or the last, as batches numbered from first."""
        rows = rows.combine_chunks()
        starts = [*range(0, rows.num_rows, size), rows.num_rows]
        lengths = rows[size_of].to_pylist()
        groups = [lengths[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        structs = pa.StructArray.from_arrays([rows[c].combine_chunks() if isinstance(rows[c], pa.ChunkedArray) else rows[c] for c in kept], kept)
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), structs)
        ints = lambda values: pa.array(values, pa.int64())
        columns = [pa.array([rows[part][0].as_py()] * len(groups), pa.int32()), ints(range(first, first + len(groups))), ints(map(len, groups)), ints(map(max, groups)), ints(max(g) * len(g) - sum(g) for g in groups), lists]
        return pa.RecordBatch.from_arrays(columns, ["part", "batch", "n", "longest", "padding", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, first = None, 0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            whole = rows.num_rows // size * size
            if whole:
                yield cut(rows.slice(0, whole), first)
                first += whole // size
            rest = rows.slice(whole)
        if rest is not None and rest.num_rows:
            yield cut(rest, first)

    return ordered.mapInArrow(run, schema)


def unpacked(batches: DataFrame) -> DataFrame:
    """The rows of packed() again, each with its part and batch."""
    return batches.select("part", "batch", F.explode("rows").alias("r")).select("part", "batch", "r.*")


def map_batches(df: DataFrame, setup: Callable[[], Callable[[Batch], Batch]], outputs: str | StructType, inputs: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """df with the columns that a function returns for batches of its rows, as they come; all old columns stay.

    setup() runs once in a worker process (a model is loaded there) and returns the function, which takes the columns named in
    inputs (all, if none are) as lists of at most `size` values and returns the lists of the output columns, as long. Another
    number of values, or other columns, raise. Columns of df that outputs names are replaced. Answers are handed on after about
    a megabyte of rows, so a worker holds one of Spark's Arrow batches (spark.sql.execution.arrow.maxRecordsPerBatch) and
    little else, however many rows there are.
    """
    added = outputs if isinstance(outputs, StructType) else StructType.fromDDL(outputs)
    names, kept = added.fieldNames(), [c for c in df.columns if c not in added.fieldNames()]
    taken, call = inputs or df.columns, uuid.uuid4().hex
    schema = StructType([*(df.schema[c] for c in kept), *added.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if call not in _READY:
            _READY[call] = setup()
        function = _READY[call]
        for batch in batches:
            found, first, held = {n: [] for n in names}, 0, 0
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                out = function({c: part.column(c).to_pylist() for c in taken})
                if set(out) != set(names) or any(len(v) != part.num_rows for v in out.values()):
                    raise ValueError(f"a batch of {part.num_rows} rows gave {({k: len(v) for k, v in out.items()})}; the columns {names} are declared")
                for n in names:
                    found[n] += out[n]
                behind, held = at + part.num_rows, held + part.nbytes
                if held >= HELD_BYTES or behind == batch.num_rows:
                    own = batch.slice(first, behind - first)
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in kept), *(pa.array(found[n], kinds.field(n).type) for n in names)], [*kept, *names])
                    found, first, held = {n: [] for n in names}, behind, 0

    return df.mapInArrow(run, schema)
