"""Registered queries over sources, ordinals, batches and partial states, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .functions import text
from .operators import batches, scores, states, trees
from .operators.ordinals import OrdinalIndex
from .plans.pairs import adjacent_pairs
from .registry import query, table
from .sources.lines import read_records
from .sources.records import write_observed
from .sources.shared import fresh_path

_RECORD = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType())])
#: What is done to the line of a document, by doc_id % 11: cut short, a list, no text field, a number for the text, a faulty byte.
_FAULTS = "CASE doc_id % 11 WHEN 1 THEN 'not json' WHEN 3 THEN 'not an object' WHEN 5 THEN 'missing field' WHEN 7 THEN 'wrong type' END"


@query(f"""SELECT doc_id, {_FAULTS} AS reason, CASE WHEN {_FAULTS} IS NULL THEN md5(CASE WHEN doc_id % 11 = 9 THEN '�' ELSE '' END || text) END AS text_md5, CASE WHEN {_FAULTS} IS NULL THEN doc_id % 11 = 9 END AS replaced FROM documents""")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as JSON lines, some of them broken, and read again: the records, and the rejected by reason."""
    docs = table(spark, sf_dir, "documents")
    whole = F.to_json(F.struct("doc_id", "text", "lang"))
    kind, number = F.col("doc_id") % 11, F.col("doc_id").cast("string")
    # the number stands first in broken lines, so that it can be told from what is left
    line = (
        F.when(kind == 1, F.concat(F.lit('{"doc_id":'), number, F.lit(',"text":"'))).when(kind == 3, F.concat(F.lit("["), number, F.lit("]")))
        .when(kind == 5, F.to_json(F.struct("doc_id", "lang"))).when(kind == 7, F.concat(F.lit('{"doc_id":'), number, F.lit(',"text":{"a":1},"lang":"x"}')))
        .when(kind == 9, F.concat(F.lit('{"doc_id":'), number, F.lit(',"lang":null,"text":"'), F.expr("cast(unhex('FF') as string)"), F.expr("substring(to_json(struct(text)), 10)"))).otherwise(whole)
    )
    path = fresh_path(spark, "lines")
    docs.select(F.concat(line, F.when(F.col("doc_id") % 2 == 0, "\r").otherwise(""), F.when(F.col("doc_id") % 5 == 0, "\n \n").otherwise("")).alias("value")).write.text(path)
    got = read_records(spark, path, _RECORD)
    kept = got.records.select("doc_id", F.lit(None).cast("string").alias("reason"), F.md5("text").alias("text_md5"), "replaced")
    number = F.regexp_extract("line", r"^[^0-9]*([0-9]+)", 1).cast("long")
    return kept.unionAll(got.rejected.select(number.alias("doc_id"), "reason", F.lit(None).cast("string").alias("text_md5"), F.lit(None).cast("boolean").alias("replaced")))


@query("SELECT doc_id, idx, md5(text) AS text_md5, shown FROM (SELECT doc_id, text, row_number() OVER (ORDER BY length(text), doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents) JOIN (SELECT unnest(['record', 'slice', 'shard']) AS shown) s ON shown = 'record' AND idx IN (0, 150, n - 1) OR shown = 'slice' AND idx >= n // 2 AND idx < n // 2 + 20 OR shown = 'shard' AND idx % 7 = 3")
def ordinal_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents by length the first, the 151st and the last; twenty from the middle on; every seventh."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("size"))
    index = OrdinalIndex(docs, "size", "doc_id")
    n = index.count()
    parts = [("record", index.record(k)) for k in (0, 150, n - 1)] + [("slice", index.records(n // 2, n // 2 + 20)), ("shard", index.shard(3, 7))]
    shown = [df.select("doc_id", "idx", F.md5("text").alias("text_md5"), F.lit(name).alias("shown")) for name, df in parts]
    out = shown[0]
    for more in shown[1:]:
        out = out.unionAll(more)
    return out


@query("SELECT doc_id, CAST(1 AS BIGINT) AS n_batches, CAST(length(text) AS BIGINT) AS length, true AS fits FROM documents")
def packed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one batch of at most four, which knows its longest text and its padding."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("length"))
    packs = batches.packed(docs, F.col("length"))
    total = F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["length"])
    fits = (F.col("n") <= batches.SIZE) & (F.col("n") == F.size("rows")) & (F.col("longest") == F.array_max("rows.length")) & (F.col("padding") == F.col("n") * F.col("longest") - total)
    each = packs.select(fits.alias("fits"), F.explode("rows").alias("r")).select("fits", "r.*")
    return each.groupBy("doc_id", "length").agg(F.count("*").alias("n_batches"), F.bool_and("fits").alias("fits"))


def _stand_in():
    """Set-up of what stands for a model here: it answers with the prompt's words in order, in a fence."""
    return lambda batch: {"response": [f"### Response:\n```dart\n{' '.join(sorted((t or '').split(' ')))}\n```" for t in batch["text"]], "n_batch": [len(batch["text"])] * len(batch["text"])}


@query("SELECT doc_id, md5(regexp_replace(array_to_string(list_sort(string_split(text, ' ')), ' '), '^\\s+|\\s+$', '', 'g')) AS code, true AS in_batch, source FROM documents")
def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to all documents by a function over batches of four, and the code in them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    answered = batches.map_batches(docs, _stand_in, "response string, n_batch int", ["text"])
    return answered.select("doc_id", F.md5(text.fenced_block(F.col("response"), F.lit("dart"))).alias("code"), F.col("n_batch").between(1, 4).alias("in_batch"), "source")


@query('SELECT event_type, round(min(value), 6) AS "Min", round(max(value), 6) AS "Max", round(avg(value), 6) AS "Average", round(coalesce(stddev_samp(value), 0.0), 6) AS "Standard_Deviation", count(value) AS "Count" FROM events GROUP BY event_type HAVING count(value) > 0')
def gathered_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all events from the partial states of seven shards, one of them written late and one twice."""
    events, path = table(spark, sf_dir, "events"), fresh_path(spark, "states")
    shard = lambda k: events.where(F.pmod("event_id", F.lit(7)) == k)
    for k in (0, 1, 2, 3, 3, 4, 5, 6):
        states.write_shard(shard(k), "value", "event_type", path, str(k))
    found = states.as_statistics(states.merged(states.read_states(spark, path), "event_type"), "event_type")
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


def _fragile(text: str) -> trees.Nodes:
    """The parser, but for texts that it is made to fail on, and nodes that lead nowhere."""
    if "th" in text:
        raise ValueError("a text with th")
    nodes = trees.parse_code(text)
    return [*nodes, ("identifier", 0, 1, 99_999)] if "an" in text else nodes


_FAILS = "SELECT '{0} ' || CASE WHEN contains({0}, 'th') THEN 'tree: ValueError' ELSE 'edges: IndexError' END AS failure FROM (SELECT a.text AS ref, b.text AS hyp FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant') WHERE contains({0}, 'th') OR contains({0}, 'an')"


@query(f"SELECT failure, count(*) AS n FROM ({_FAILS.format('ref')} UNION ALL {_FAILS.format('hyp')}) GROUP BY failure")
def score_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that took a default because a text's tree or edges failed, counted by kind."""
    return scores.failure_counts(scores.composite(adjacent_pairs(spark, sf_dir), "dart", parsers={"dart": _fragile}, failures=True))


@query("SELECT count(*) AS seen, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, count(*) AS written FROM events")
def observed_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their value as the score, written; what the write itself has seen, and the rows that can be read."""
    path = fresh_path(spark, "scores")
    seen = write_observed(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), lambda df: df.write.parquet(path), "value")
    total, mean = (F.lit(x).cast("double") for x in (seen.total, seen.mean))
    return spark.read.parquet(path).agg(F.count("*").alias("written")).select(F.lit(seen.rows).cast("long").alias("seen"), F.round(total, 4).alias("total"), F.round(mean, 6).alias("mean"), "written")
