"""JSON lines with a quarantine: what cannot be read is a row of its own, with its file, place and reason.

Lines end at a line feed, a carriage return before it is white space. They are split where they are stored, whatever the
size of a file; a line's place follows from the lengths of the lines before it, which only faulty files are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .records import EVALUATION

#: Why a line is rejected.
NOT_JSON, NOT_OBJECT, MISSING, WRONG_TYPE = "not json", "not an object", "missing field", "wrong type"


@dataclass
class Records:
    """records: the schema's columns and replaced (faulty bytes became replacement characters).
    rejected: file, offset and length in bytes, reason, line."""

    records: DataFrame
    rejected: DataFrame


def _reason(line: Column, parsed: Column, schema: StructType, required: tuple[str, ...]) -> Column:
    """Null for a line that holds a record. A string is no other JSON value, though from_json would take it as text."""
    whole = F.try_parse_json(line)
    kind = F.schema_of_variant(whole)
    lacks = F.lit(False)
    for name in required:
        lacks = lacks | ~F.coalesce(F.array_contains(F.json_object_keys(line), name), F.lit(False))
    other = parsed["_line"].isNotNull()
    for field in schema.fields:
        if field.dataType == StringType():
            own = F.schema_of_variant(F.try_variant_get(whole, f"$['{field.name}']", "variant"))
            other = other | ~F.coalesce(own, F.lit("VOID")).isin("STRING", "VOID")
    reason = F.when(whole.isNull(), NOT_JSON).when(~F.startswith(kind, F.lit("OBJECT")), NOT_OBJECT).when(lacks, MISSING)
    return reason.when(other, WRONG_TYPE)


def read_records(spark: SparkSession, path: str, schema: StructType = EVALUATION, required: tuple[str, ...] | None = None) -> Records:
    """The records of JSON lines and the lines that are none.

    Bytes that are no UTF-8 become replacement characters before a line is parsed. Blank lines are skipped. A line is rejected
    if it is no JSON, no object, lacks a required field (all of the schema, unless given) or holds another type than the
    schema's; a field may be null. Fields beyond the schema are ignored. A file's byte order mark counts as no bytes.
    """
    required = tuple(schema.fieldNames()) if required is None else required
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), (F.octet_length("value") + 1).alias("size"), "value")
    text = F.make_valid_utf8("value")
    full = StructType([*schema.fields, StructField("_line", StringType())])
    read = lines.select("file", "block", "at", "size", "value", text.alias("line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    read = read.withColumn("parsed", F.from_json("line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"}))
    judged = read.withColumn("reason", _reason(F.col("line"), F.col("parsed"), schema, required))
    records = judged.where("reason is null").select(*[F.col("parsed")[c].alias(c) for c in schema.fieldNames()], (~F.is_valid_utf8("value")).alias("replaced"))
    bad = judged.where("reason is not null").select("file", "block", "at", "reason", "line", "size")
    # places: the lengths of the lines of files that hold a faulty one, without their text
    faulty = bad.select("file").distinct()
    sizes = lines.select("file", "block", "at", "size").join(faulty, "file", "left_semi")
    own = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.select("file", "block", "at", F.coalesce(F.sum("size").over(own), F.lit(0)).alias("inside"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy("file", "block").agg(F.sum("size").alias("bytes")).select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    placed = bad.join(inside, ["file", "block", "at"]).join(blocks, ["file", "block"])
    return Records(records, placed.select("file", (F.col("start") + F.col("inside")).alias("offset"), (F.col("size") - 1).cast("long").alias("length"), "reason", "line"))
