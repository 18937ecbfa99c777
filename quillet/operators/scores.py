"""The composite score of a pair and of a corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import detect_language, keywords, language_points
from . import trees
from .bleu import bleu_of, order_sums, sized
from .multiset import clipped_items, edge_match, gram_items, keyword_share, label_items, plain_share

PARTS = ("bleu", "weighted_bleu", "ast_match", "dataflow_match")
EVEN = (0.25, 0.25, 0.25, 0.25)
ORDER, LABEL = 4, 0
#: Parts of the score that a failed text takes its default in.
FAILED = "failed"


def checked(weights: tuple[float, float, float, float]) -> tuple[float, ...]:
    if len(weights) != 4 or abs(sum(weights) - 1) > 1e-6:
        raise ValueError(f"four weights that sum to 1 are needed, not {weights}")
    return weights


def _scored(tagged: DataFrame, languages: tuple[str, ...], weights: tuple[float, ...], parsers: dict[str, Callable]) -> DataFrame:
    """tagged (pair_id, refs, hyp, lang) -> pair_id, lang, the four parts, codebleu and failed; without a language scores are null.

    One pass: the pairs are dealt out once, each text is tokenised and parsed once, and one grouped count of n-grams and
    tree labels gives all parts.
    """
    words, w = {name: keywords(name) for name in languages}, checked(weights)
    first = F.coalesce(F.get("refs", F.lit(0)), F.lit(""))
    # parsed before the rows are dealt out: a Python step does not keep their partitioning
    parsed = tagged.select("pair_id", "refs", "hyp", "lang", trees.analysed(first, F.col("hyp"), F.col("lang"), {name: parsers[name] for name in languages}).alias("t"))
    rows = sized(parsed, F.col("t"), F.col("lang"))
    rows = rows.withColumn("flow", edge_match(F.col("t.ref.edges"), F.col("t.hyp.edges")))
    items = F.concat(gram_items(ORDER), label_items(LABEL, F.col("t.hyp.labels"), F.col("t.ref.labels")))
    fault = lambda side: F.concat(F.lit(side + " "), F.col(f"t.{side}.fault"))
    rows = rows.withColumn(FAILED, F.array_compact(F.array(fault("ref"), fault("hyp"))))
    carried = ("lang", "n_h", "n_r", "flow", FAILED)
    sums = clipped_items(rows, items, carried).groupBy("pair_id", *carried)
    known = F.lit(False)
    for name, some in words.items():
        known = F.when(F.col("lang") == name, F.col("item").isin(*some)).otherwise(known)
    out = sums.agg(*order_sums(ORDER), keyword_share(1, known).alias("weighted_bleu"), plain_share(LABEL).alias("ast_match"))
    out = out.select("pair_id", "lang", bleu_of(ORDER).alias("bleu"), "weighted_bleu", "ast_match", F.col("flow").alias("dataflow_match"), FAILED)
    total = sum((F.lit(x) * F.col(p) for x, p in zip(w, PARTS, strict=True)), F.lit(0.0)).alias("codebleu")
    return out.select("pair_id", "lang", *[F.when(F.col("lang").isNotNull(), x).alias(n) for n, x in zip((*PARTS, "codebleu"), (*map(F.col, PARTS), total), strict=True)], FAILED)


def composite(pairs: DataFrame, language: str, weights: tuple[float, float, float, float] = EVEN, parsers: dict[str, Callable] = trees.PARSERS, all_scores: bool = True, failures: bool = False) -> DataFrame:
    """pairs (pair_id, refs, hyp) -> pair_id, the four parts (if all_scores) and codebleu. Trees are compared with the first reference.

    Null texts count as empty; a pair_id names one pair. A text that the parser fails on scores 0 in its part; with failures the
    column `failed` lists the side, the step and the error of each such default, found in the same pass.
    """
    out = _scored(pairs.withColumn("lang", F.lit(language.lower())), (language.lower(),), weights, parsers)
    return out.select("pair_id", *(PARTS if all_scores else ()), "codebleu", *((FAILED,) if failures else ()))


def failure_counts(scores: DataFrame) -> DataFrame:
    """(failure, n) of each kind over scores with failures; none for pairs without."""
    return scores.select(F.explode(FAILED).alias("failure")).groupBy("failure").agg(F.count("*").alias("n"))


def tree_match(pairs: DataFrame, language: str, parsers: dict[str, Callable] = trees.PARSERS) -> DataFrame:
    """pairs (pair_id, refs, hyp) -> (pair_id, value): share of the hypothesis's inner nodes that the first reference's tree has too, by label, clipped."""
    first = F.coalesce(F.get("refs", F.lit(0)), F.lit(""))
    rows = pairs.select("pair_id", trees.analysed(first, F.col("hyp"), F.lit(language), parsers).alias("t")).repartition("pair_id")
    return clipped_items(rows, label_items(LABEL, F.col("t.hyp.labels"), F.col("t.ref.labels"))).groupBy("pair_id").agg(plain_share(LABEL).alias("value"))


def detected_language(code: Column, undecided: str = "null") -> Column:
    """The language with more points; on a tie the first in which the code parses without errors.

    Code that parses in none is null, or raises when the plan runs with undecided="raise".
    """
    if undecided not in ("null", "raise"):
        raise ValueError(f"undecided is 'null' or 'raise', not {undecided!r}")
    found = F.coalesce(detect_language(language_points(code)), trees.first_to_parse(code))
    return found if undecided == "null" else F.coalesce(found, F.raise_error(F.lit("the language of a text cannot be told")))


def score_detected(pairs: DataFrame, weights: tuple[float, float, float, float] = EVEN, undecided: str = "null", all_scores: bool = True) -> DataFrame:
    """composite() of every pair in the language that its first reference speaks for; undecided pairs have null scores."""
    tagged = pairs.withColumn("lang", detected_language(F.coalesce(F.get("refs", F.lit(0)), F.lit("")), undecided))
    out = _scored(tagged, ("dart", "swift"), weights, trees.PARSERS)
    return out.select("pair_id", "lang", *(PARTS if all_scores else ()), "codebleu")


def corpus(scores: DataFrame) -> DataFrame:
    """Means of the parts over all pairs (NULL for none), and their number. The details are the rows of scores themselves."""
    return scores.agg(*[F.avg(n).alias(n) for n in (*PARTS, "codebleu")], F.count("*").alias("n_pairs"))


def corpus_details(scores: DataFrame) -> DataFrame:
    """A row for each pair, and one with the means of all (pair_id null, is_total true)."""
    names = [*PARTS, "codebleu"]
    each = scores.select("pair_id", *names, F.lit(False).alias("is_total"))
    return each.unionAll(corpus(scores).select(F.lit(None).cast(scores.schema["pair_id"].dataType).alias("pair_id"), *names, F.lit(True).alias("is_total")))


def flattened(lists: DataFrame, column: str) -> DataFrame:
    """lists with a row for each element of an array column, in the array's place: gathered lists as one bag."""
    return lists.withColumn(column, F.explode(column))


def zip_pairs(refs: DataFrame, hyps: DataFrame) -> DataFrame:
    """refs (idx, refs) and hyps (idx, hyp) by position; a position that one side lacks raises when the plan runs."""
    both = refs.withColumn("in_refs", F.lit(True)).join(hyps.withColumn("in_hyps", F.lit(True)), "idx", "full_outer")
    message = F.concat(F.lit("lists differ in length at position "), F.col("idx").cast("string"))
    guard = F.when(F.col("in_refs").isNull() | F.col("in_hyps").isNull(), F.raise_error(message)).otherwise(F.col("idx"))
    return both.select(guard.cast("long").alias("pair_id"), "refs", "hyp")
