"""Dominance counts against brute force: ties, hot slots and levels, nulls, repeated rows, clashing columns, many shards."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.llm import dominance

SCHEMA = "slot long, level long, weight long"


def brute(rows):
    out = []
    for s, v, *_ in rows:
        if s is None or v is None:
            out.append((None, None))
        else:
            above = [w or 0 for a, b, w in rows if a is not None and b is not None and a <= s and b > v]
            out.append((len(above), sum(above)))
    return out


def test_tree_counts_every_prefix():
    r = np.random.default_rng(1)
    for m in (1, 2, 3, 7, 8, 9, 31):
        values, weights = r.integers(-5, 5, m), r.integers(0, 4, m)
        places, asked = np.repeat(np.arange(m + 1), 12), np.tile(np.arange(-6, 6), m + 1)
        count, weight = dominance.MergeSortTree(values, weights).above(places, asked)
        want = [(values[:p] > v).sum() for p, v in zip(places, asked, strict=True)]
        assert count.tolist() == want
        assert weight.tolist() == [weights[:p][values[:p] > v].sum() for p, v in zip(places, asked, strict=True)]


@pytest.mark.parametrize("shard_rows", [7, 1 << 17])
@pytest.mark.parametrize("kind", ["hot", "one"])
def test_counts(spark, kind, shard_rows):
    r = np.random.default_rng(2)
    rows = []
    for i in range(400):
        hot = kind == "one" or kind == "hot" and i % 3 == 0
        slot, level = (5, 7) if hot else (int(r.integers(-9, 30)), int(r.integers(0, 25)))
        if kind == "hot" and i % 5 == 0:
            slot, level = 5, int(r.integers(0, 25))
        rows.append((slot if i % 41 else None, level if i % 37 else None, int(r.integers(0, 3)) if i % 29 else None))
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id int, " + SCHEMA)
    for name in ("tie_of", "shard", "shard_of", "block", "n", "w", "load_of", "n_above"):
        df = df.withColumn(name, F.lit("extra"))
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = dominance.dominance_counts(df.repartition(5), "slot", "level", "weight", shard_rows=shard_rows)
        assert got.columns == [*[c for c in df.columns if c != "n_above"], "n_above", "w_above"]
        found = {x["id"]: (x["n_above"], x["w_above"]) for x in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found == dict(enumerate(brute(rows)))


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dominance.dominance_counts(empty, "slot", "level", "weight").collect() == []
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, 1)], SCHEMA)
    assert [x[-2:] for x in dominance.dominance_counts(nulls, "slot", "level", "weight").collect()] == [(None, None)] * 2


def test_sale_points(spark):
    rows = [(1, 10.005, "2024-01-01 23:59:59.9"), (-7, 0.0, "1969-12-31 23:59:59"), (3, -0.5, None), (None, None, "2024-03-31 02:30:00"), (4, float("nan"), "2024-01-01"), (5, float("inf"), "2024-01-01"), (6, 37983.14, "1970-01-01 01:00:00")]
    df = spark.createDataFrame(rows, "sale_id long, total double, sold_at string").withColumn("sold_at", F.col("sold_at").cast("timestamp_ntz"))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [tuple(x) for x in dominance.sale_points(df).collect()]
        aware = [x["slot"] for x in dominance.sale_points(df.withColumn("sold_at", F.to_timestamp(F.concat(F.col("sold_at").cast("string"), F.lit("Z"))))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    slots = [473375, -1, None, 475514, 473352, 473352, 1]
    assert [x[1] for x in got] == slots == aware
    assert [x[2] for x in got] == [10, 0, -1, None, None, None, 37983]
    assert [x[3] for x in got] == [1 + zlib.crc32(b"" if i is None else str(i).encode()) % 2 for i, *_ in rows]
