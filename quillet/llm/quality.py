"""Quality rules with cross-document line frequency. DataFrame functions only.

Per document: counts of words, symbols, repeated lines and repeated three-word windows. Across documents: every
normalised line is hashed and the distinct documents that hold it are counted per host (`source`); lines above the
limit are boilerplate, and a document that consists mostly of boilerplate is depleted and rejected.

Copies of a document neither make its lines boilerplate nor hide that others are: on both sides of the limit documents count
as distinct by the hash of their normalised lines in order, so exact copies count once. Documents that differ in any line, near copies too, count apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACE_RE, free_name, stored, text_of, words_of

SYMBOLS = "#*$%&|<>"
NO_HOST = "\x00none"


@dataclass(frozen=True)
class QualityLimits:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A line is boilerplate if more distinct documents of its host hold it than this number and this share of them.
    max_line_docs: int = 8
    max_line_share: float = 0.002
    #: A document is depleted if boilerplate lines hold more than this share of its words.
    max_removed_share: float = 0.5


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeated_words(words: Column) -> Column:
    """Words in three-word windows found twice or more. Windows are compared by 64-bit hash within one document."""
    n = F.size(words)
    windows = F.when(
        n >= 3,
        F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")))),
    )
    return windows


def _covered(windows: Column) -> Column:
    same = lambda i, j: F.get(windows, i)["h"] == F.get(windows, j)["h"]
    twice = F.filter(windows, lambda x, i: F.coalesce((i > 0) & same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda x: x["p"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(
        places,
        start,
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )


def normalised_line(line: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(line, SPACE_RE, " "), F.lit(" ")))


def document_features(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, text_key, the counts, host and the hashed lines with their word counts."""
    base = docs.select("doc_id", F.col("source").alias("host"), F.xxhash64(text_of()).alias("text_key"), text_of().alias("t"))
    split = base.select(
        "*",
        words_of(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    with_windows = split.select("*", _repeated_words(F.col("w")).alias("windows"))
    host = F.coalesce(F.col("host"), F.lit(NO_HOST))
    return with_windows.select(
        "doc_id",
        "text_key",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(_without(F.col("t"), SPACE_CHARS)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("windows")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(host, normalised_line(x)).alias("h"), F.size(words_of(x)).alias("n"))).alias("lines"),
    )


def boilerplate_lines(features: DataFrame, limits: QualityLimits) -> DataFrame:
    """(h): lines of a host that more distinct documents hold than the limits allow."""
    hashes = F.transform("lines", lambda x: x["h"])
    # one row for each line and distinct document, then their number; both shuffles carry hashes only
    doc = F.xxhash64(hashes).alias("doc")
    holders = features.select("host", doc, F.explode(F.array_distinct(hashes)).alias("h")).distinct()
    counts = holders.groupBy("h", "host").agg(F.count("*").alias("n")).where(F.col("n") > limits.max_line_docs)
    per_host = features.select("host", doc).distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    return counts.join(per_host, counts["host"].eqNullSafe(per_host["host"])).where(F.col("n") > F.col("host_docs") * limits.max_line_share).select("h")


def quality_verdicts(docs: DataFrame, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """One row per row of docs with counts, removed_words, base_failed, depleted and kept.

    Null texts count as empty and fail the word minimum; a null source is a host of its own; repeated rows get equal
    rows; no rows give no rows; columns beyond doc_id, text and source are ignored.
    """
    found = _verdicts(stored(document_features(docs).withColumn("row", F.monotonically_increasing_id()), "quality"), limits)
    return found.drop("row", "host", "bad")


def _verdicts(features: DataFrame, limits: QualityLimits) -> DataFrame:
    """features (with row) judged; bad: the hashes of a document's boilerplate lines."""
    bad = stored(boilerplate_lines(features, limits), "boilerplate")
    removed = (
        features.select("row", F.explode("lines").alias("l")).select("row", F.col("l.h").alias("h"), F.col("l.n").alias("n"))
        .join(bad, "h").groupBy("row").agg(F.sum("n").alias("removed_words"), F.collect_set("h").alias("bad"))
    )
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    depleted = F.col("removed_words") > limits.max_removed_share * F.col("n_words")
    out = features.drop("lines").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    return out.withColumn("base_failed", failed).withColumn("depleted", depleted).withColumn("kept", ~failed & ~depleted)


def clean_documents(docs: DataFrame, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """The rows of docs that pass, with all their columns, their text without the boilerplate lines of its host.

    A column n_chars follows the text. Verdicts and lines depend on text and source only: rows that agree in doc_id, text
    and source are treated alike. Null and empty texts are rejected (too few words), a null source is a host of its own, every
    repeated row that passes stays, extra columns pass through whatever their names, and no rows give no rows.
    """
    a, b, c, n, gone = (free_name(docs, k) for k in ("k_id", "k_text", "k_host", "k_kept", "k_bad"))
    found = _verdicts(stored(document_features(docs).withColumn("row", F.monotonically_increasing_id()), "quality"), limits)
    acted = found.where(~F.col("kept") | F.col("bad").isNotNull()).select(F.col("doc_id").alias(a), F.col("text_key").alias(b), F.col("host").alias(c), F.col("kept").alias(n), F.sort_array("bad").alias(gone))
    acted = stored(acted.distinct(), "acted")
    same = docs["doc_id"].eqNullSafe(acted[a]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == acted[b]) & docs["source"].eqNullSafe(acted[c])
    both = docs.join(acted, same, "left").where(F.coalesce(F.col(n), F.lit(True)))
    host = F.coalesce(F.col("source"), F.lit(NO_HOST))
    left = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col(gone), F.xxhash64(host, normalised_line(x))))
    both = both.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        both = both.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return both.select(*docs.columns)
