"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u, v) of longs -> (node, root): the least node that each node of an edge can reach.

    Self loops, repeated and reversed edges are allowed; no edges give no rows. Every round is one job whose result
    is written to the shared folder, and the round before it deleted; each row of a round is an edge, so the volume never
    exceeds that of the input. A round that changes neither the number of edges nor their 64-bit hash sum is the last. The
    method takes O(log n) rounds on every graph it was measured on; max_rounds is far above, and beyond it this raises.
    """
    e = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e, "cc")
    seen = _signature(e)
    if not seen[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: each larger neighbour moves to the least of the neighbourhood
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node and its smaller neighbours move to the least of those
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        last, e = e, stored(small.where(F.col("u") != F.col("v")).distinct(), "cc")
        discard(last)
        now = _signature(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
