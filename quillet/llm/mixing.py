"""Mixing of sources to target weights by weighted fair queueing. DataFrame functions only.

Every source offers its shuffled documents, and once they are used up the same documents again, `passes` times. A
document's virtual finish time is its source's cumulative words, itself included, divided by the source's target. The
queue of all sources is sorted by that time and cut where the total budget is reached.

Cumulative sums never put a source into one task: documents fall into cells by their shuffle hash, cell sums are added
up over a small table, and only the documents of one cell are ordered within a task. With n documents there are about
sqrt(n) cells, so both levels stay small. The global cut works the same way on ranges of virtual time. The hash is that of
id and text; rows that agree in both and in the source stand as one with their number, so no copies crowd a cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.routing import with_ordinal
from .common import discard, free_name, stored, text_of, words_of

WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size) -> with weight and target. weights repeat along the sources by code point, null last.

    Water filling: target = min(weight * level, most * source_size). With the sources sorted by the level at which each is
    full, the level is the first at which the rest can take what is left. One row a source, so windows over all of them
    hold a small table.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("full", most * F.col("source_size") / F.col("weight"))
    every = Window.partitionBy()
    by_full = Window.orderBy("full", F.col("source").isNull(), "source")
    before = by_full.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("level", level).withColumn("rank", F.row_number().over(by_full))
    # the first along the order: later rows count sources as full that are not
    found = F.min(F.when(F.col("level") <= F.col("full"), F.struct("rank", "level"))).over(every)["level"]
    target = F.when(found.isNull(), most * F.col("source_size")).otherwise(F.least(F.col("weight") * found, most * F.col("source_size")))
    return w.select("source", "source_size", "weight", target.cast("double").alias("target"))


def _running(rows: DataFrame, keys: list[str], cell: str, order: list[str], value: str, out: str) -> DataFrame:
    """rows with the running sum of value by keys along (cell, order), ordered within single cells only."""
    sums = rows.groupBy(*keys, cell).agg(F.sum(value).alias("cell_sum"))
    up = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    before = stored(sums.select(*keys, cell, F.coalesce(F.sum("cell_sum").over(up), F.lit(0)).alias("before")), "cells")
    inner = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    on = F.lit(True)
    for k in [*keys, cell]:
        on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}"))
    ran = rows.withColumn("ran", F.sum(value).over(inner))
    return ran.alias("r").join(before.alias("b"), on).select("r.*", (F.col("ran") + F.col("before")).alias(out)).drop("ran")


def _sized(docs: DataFrame, seed: int, *kept: str) -> DataFrame:
    """kept, doc_id, source, size and the shuffle hash."""
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5(text_of())))
    return docs.select(*kept, "doc_id", "source", word_count(text_of()).alias("size"), hashed.alias("hash"))


def mix_plan(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, passes: int = 2) -> tuple[DataFrame, DataFrame]:
    """sized (doc_id, source, size, hash) -> (plan, rows). rows: one for each distinct row (row, doc_id, source, hash, size,
    n, source_size, target), n the number of equal ones. plan: one row for each taken copy (row, nth, pass, finish), nth
    from 1 to n.

    Null texts have size 0 and finish with the document before them; a null source is a source; sources without words have
    target 0; no rows give no rows.
    """
    each = sized.groupBy("doc_id", "source", "hash", "size").agg(F.count("*").alias("n")).withColumn("words", F.col("size") * F.col("n"))
    each = stored(each.withColumn("row", F.monotonically_increasing_id()), "sizes")
    targets = stored(source_targets(each.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, float(passes)), "targets")
    facts = each.agg(F.count("*").alias("n"), F.sum("words").alias("words")).first()
    cells = 1 << (facts["n"].bit_length() + 1) // 2
    # cells follow the hash's first hex digits, so cell order is hash order
    dealt = each.withColumn("cell", F.floor(F.conv(F.substring("hash", 1, 7), 16, 10).cast("long") * cells / (1 << 28)))
    few = F.broadcast(targets) if targets.count() <= 10_000 else targets
    summed = _running(dealt, ["source"], "cell", ["hash", "doc_id"], "words", "sum").alias("s").join(few.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "source_size", "target")
    rows = stored(summed, "queued")
    taking = rows.where("size > 0 and target > 0").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth"))
    again = taking.select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    upto = F.col("sum") - F.col("words") + F.col("nth") * F.col("size")
    queue = again.select("row", "nth", "size", "hash", "pass", ((upto + F.col("pass") * F.col("source_size")) / F.col("target")).alias("finish"))
    # ranges of virtual time; a source's documents finish evenly along it, so ranges are even too
    queue = queue.withColumn("range", F.floor(F.col("finish") * cells))
    sums = queue.groupBy("range").agg(F.sum("size").alias("range_sum"))
    total = F.sum("range_sum").over(Window.orderBy("range"))
    budget = F.floor(F.lit(share) * F.lit(facts["words"] or 0))
    state = sums.select("range", total.alias("upto"), (total - F.col("range_sum")).alias("before")).where(F.col("before") < budget)
    state = stored(state, "ranges")
    inside = queue.join(state, "range")
    whole = inside.where(F.col("upto") <= budget)
    # only the range in which the budget runs out has to be ordered
    order = Window.partitionBy("range").orderBy("finish", "hash", "pass", "nth", "row")
    last = inside.where(F.col("upto") > budget).withColumn("total", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    columns = ["row", "nth", "pass", "finish"]
    return whole.select(*columns).unionAll(last.where(F.col("total") <= budget).select(*columns)), rows.drop("words", "cell", "sum")


def mix_counts(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, passes: int = 2, seed: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, times and taken (words, repeats counted)."""
    plan, rows = mix_plan(_sized(docs, seed), weights, share, passes)
    times = plan.groupBy("row", "nth").agg(F.count("*").alias("times"))
    each = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth"))
    out = each.join(times, ["row", "nth"], "left").withColumn("times", F.coalesce("times", F.lit(0)).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, passes: int = 2, seed: int = 0) -> DataFrame:
    """docs as mixed: each row, with all its columns, as often as the mix takes it.

    Null and empty texts have no words and are never taken; a null source is a source of its own, the last; rows that are
    equal in id and text are taken in turn, each with its own columns; texts of any length are taken whole; extra columns pass
    through whatever their names; no rows give no rows.
    """
    place, times = free_name(docs, "k_place"), free_name(docs, "k_times")
    numbered = stored(docs.withColumn(place, F.monotonically_increasing_id()), "numbered")
    sized = stored(_sized(numbered, seed, place).withColumnRenamed(place, "place"), "sized")
    plan, rows = mix_plan(sized, weights, share, passes)
    both = sized.alias("s").join(rows.select("source", "hash", "row", "n").alias("r"), F.col("s.source").eqNullSafe(F.col("r.source")) & (F.col("s.hash") == F.col("r.hash")))
    found = stored(both.select("place", "row", "n"), "places")
    nth = found.where("n = 1").select("place", "row", F.lit(1).cast("long").alias("nth"))
    if not found.where("n > 1").isEmpty():
        # equal rows are numbered along all of them, then from their first on: none of their groups is one task
        counted = with_ordinal(found.where("n > 1"), "row", "place")
        first = counted.groupBy("row").agg(F.min("idx").alias("least"))
        nth = nth.unionAll(counted.join(first, "row").select("place", "row", (F.col("idx") - F.col("least") + 1).alias("nth")))
    taken = plan.groupBy("row", "nth").agg(F.count("*").alias(times)).join(nth, ["row", "nth"]).select(F.col("place").alias(place), times)
    taken = stored(taken, "times")
    discard(sized, found)
    return numbered.join(taken, place).select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias(times)).drop(times)
