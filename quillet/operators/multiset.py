"""Multiset operators over pairs of texts: pairs (pair_id, refs array<string>, hyp string).

A pair's texts are tokenised once, in its own row. All that is to be counted of a pair (n-grams of every order, labels)
is an array of (side, kind, item) made after the pairs were dealt out by pair_id, so that one exchange of texts serves
every count, clip and sum. A pair_id names one pair: rows that repeat it are clipped apart and their sums are pooled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import KEYWORD_WEIGHT
from ..functions.text import bound, ngrams, tokenize

HYP = -1
ITEM = "array<struct<side:int,kind:int,item:string>>"


def tokenised(pairs: DataFrame, *more: Column) -> DataFrame:
    """pairs dealt out by pair_id -> pair_id, h (tokens of the hypothesis), rs (tokens of each reference), more."""
    none = F.array().cast("array<string>")
    rs = F.transform(F.coalesce("refs", none), lambda r: tokenize(r))
    return pairs.repartition("pair_id").select("pair_id", tokenize(F.col("hyp")).alias("h"), rs.alias("rs"), *more)


def _items(side: Column | int, kind: int, values: Column) -> Column:
    side = side.cast("int") if isinstance(side, Column) else F.lit(side)
    return F.transform(values, lambda x: F.struct(side.alias("side"), F.lit(kind).alias("kind"), x.alias("item")))


def gram_items(orders: int) -> Column:
    """(side, kind, item) of all n-grams of h and rs; the kind is n."""

    def of(n: int) -> list[Column]:
        return [_items(HYP, n, ngrams(F.col("h"), n)), F.flatten(F.transform("rs", lambda r, i: _items(i, n, ngrams(r, n))))]

    return F.concat(*[x for n in range(1, orders + 1) for x in of(n)]).cast(ITEM)


def label_items(kind: int, hyp: Column, ref: Column) -> Column:
    """(side, kind, item) of two arrays of labels."""
    return F.concat(_items(HYP, kind, hyp), _items(0, kind, ref)).cast(ITEM)


def clipped(items: DataFrame, keys: list[str]) -> DataFrame:
    """items (pair_id, side, *keys), one row an occurrence -> (pair_id, *keys, n, common) of the hypothesis.

    common is the largest over the references of the smaller count.
    """
    counts = items.groupBy("pair_id", "side", *keys).agg(F.count("*").alias("c"))
    own = F.max(F.when(F.col("side") == HYP, F.col("c")))
    most = F.max(F.when(F.col("side") >= 0, F.col("c")))
    both = counts.groupBy("pair_id", *keys).agg(own.alias("n"), F.coalesce(most, F.lit(0)).alias("r"))
    return both.where("n is not null").select("pair_id", *keys, "n", F.least("n", "r").alias("common"))


def _runs(values: Column, names: tuple[str, ...], of: Callable[[Column, Column], Column]) -> Column:
    """of(first place, length) of every run of neighbours in an array of structs that agree in these fields."""

    def begins(x: Column, i: Column) -> Column:
        differs = F.lit(False)
        for name in names:
            differs = differs | (x[name] != F.get(values, i - 1)[name])
        return F.when((i == 0) | differs, i)

    each = lambda starts: F.transform(starts, lambda p, k: of(p, F.coalesce(F.get(starts, k + 1), F.size(values)) - p))
    return bound(F.filter(F.transform(values, begins), lambda p: p.isNotNull()), each)


def clipped_array(items: Column) -> Column:
    """array of (side, kind, item) -> array of (kind, item, n, common) of the hypothesis's items, found in the row itself.

    Sorted, equal items stand side by side, the hypothesis's first: runs of one side are its count, runs of all sides an item.
    """
    in_order = F.sort_array(F.transform(items, lambda x: F.struct(x["kind"].alias("kind"), x["item"].alias("item"), x["side"].alias("side"))))

    def counts(s: Column) -> Column:
        field = lambda p, name: F.get(s, p)[name].alias(name)
        return _runs(s, ("item", "side", "kind"), lambda p, n: F.struct(field(p, "kind"), field(p, "item"), field(p, "side"), n.cast("long").alias("n")))

    def clip(c: Column) -> Column:
        field = lambda p, name: F.get(c, p)[name].alias(name)
        most = lambda p, n: F.when(n == 1, 0).otherwise(F.array_max(F.slice(c, p + 2, n - 1)["n"]))
        own = lambda p, n: F.struct(field(p, "kind"), field(p, "item"), field(p, "n"), F.least(field(p, "n"), most(p, n)).alias("common"))
        return F.filter(_runs(c, ("item", "kind"), lambda p, n: F.when(F.get(c, p)["side"] == HYP, own(p, n))), lambda x: x.isNotNull())

    return bound(bound(in_order, counts), clip)


def clipped_items(rows: DataFrame, items: Column, carried: tuple[str, ...] = ()) -> DataFrame:
    """rows (pair_id, ...) -> (pair_id, carried, kind, item, n, common): clipped() over an array of (side, kind, item).

    Every pair keeps a row, if only one without an item (n and common 0), that bears its carried columns. Items are counted in
    their own row: no table of all items is grouped, sorted or spilled.
    """
    keys = ["pair_id", *carried]
    each = rows.select(*keys, F.explode_outer(clipped_array(items)).alias("x"))
    return each.select(*keys, "x.kind", "x.item", F.coalesce("x.n", F.lit(0)).alias("n"), F.coalesce("x.common", F.lit(0)).alias("common"))


def gram_counts(pairs: DataFrame, order: int = 4) -> DataFrame:
    """(pair_id, side, n_order, n): n-grams of each side that has any, the hypothesis as side -1."""
    each = tokenised(pairs).select("pair_id", F.explode(gram_items(order)).alias("x"))
    return each.groupBy("pair_id", F.col("x.side").alias("side"), F.col("x.kind").alias("n_order")).agg(F.count("*").alias("n"))


def gram_clip(pairs: DataFrame, order: int = 4) -> DataFrame:
    """(pair_id, n_order, num, den): clipped and all n-grams of the hypothesis for each order that it has."""
    found = clipped_items(tokenised(pairs), gram_items(order)).where("n > 0")
    return found.groupBy("pair_id", F.col("kind").alias("n_order")).agg(F.sum("common").alias("num"), F.sum("n").alias("den"))


def keyword_share(kind: int, keyword: Column, weight: float = KEYWORD_WEIGHT) -> Column:
    """Aggregate over clipped_items(): share of the common items of a kind, keywords weighted; 0 where there are none."""
    w = F.when(F.col("kind") == kind, F.when(keyword, weight).otherwise(1.0))
    return F.coalesce(F.try_divide(F.sum(w * F.col("common")), F.sum(w * F.col("n"))), F.lit(0.0))


def plain_share(kind: int) -> Column:
    """Aggregate over clipped_items(): share of the common items of a kind; 0 where there are none."""
    of = F.col("kind") == kind
    return F.coalesce(F.try_divide(F.sum(F.when(of, F.col("common"))), F.sum(F.when(of, F.col("n")))), F.lit(0.0))


def weighted_precision(pairs: DataFrame, keywords: tuple[str, ...], weight: float = KEYWORD_WEIGHT) -> DataFrame:
    """(pair_id, value): clipped unigram precision with keywords counting `weight` times; 0 for an empty hypothesis."""
    return clipped_items(tokenised(pairs), gram_items(1)).groupBy("pair_id").agg(keyword_share(1, F.col("item").isin(*keywords), weight).alias("value"))


def label_match(labels: DataFrame) -> DataFrame:
    """labels (pair_id, side, label) -> (pair_id, value): share of the hypothesis's labels that the reference holds, clipped."""
    return clipped(labels, ["label"]).groupBy("pair_id").agg((F.sum("common") / F.sum("n")).alias("value"))


def edge_match(ref: Column, hyp: Column) -> Column:
    """Share of hyp's distinct edges that ref holds; with no edges in hyp 1 if ref has none either, else 0."""
    r, h = F.array_distinct(ref), F.array_distinct(hyp)
    empty = F.when(F.size(r) == 0, 1.0).otherwise(0.0)
    return F.when(F.size(h) == 0, empty).otherwise(F.size(F.array_intersect(r, h)) / F.greatest(F.size(h), F.lit(1)))
