"""Scores against all earlier user turns, without the pairs: same as over the pairs, and no list of texts goes along."""

import random

import pytest
from pyspark.sql import functions as F

from quillet.operators import bleu, dealing, history, multiset
from quillet.plans.pairs import history_pairs

NAMES = ["gram_clip", "weighted_precision", "bleu", "brevity_penalty"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Conversations of 0 to 12 turns and one of 150; null and empty texts."""
    r = random.Random(5)
    words = ["a", "b", "é", "if", "x1", "(", "// c", "\n"]
    said = lambda: r.choice([None, "", *[" ".join(r.choice(words) for _ in range(r.randint(1, 12)))] * 8])
    rows = [(c, t * 2, r.choice(["user", "assistant", "system"]), said()) for c in range(30) for t in range(150 if c == 7 else r.randint(0, 12))]
    path = tmp_path_factory.mktemp("turns")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_over_the_pairs(spark, folder, name):
    turns, more = spark.read.parquet(f"{folder}/conversations.parquet"), [("if", "a")] if name == "weighted_precision" else []
    over = getattr(multiset if name in NAMES[:2] else bleu, name)
    numbered = (F.col("conv_id") * 1048576 + F.col("turn")).alias("pair_id")
    mine = getattr(history, name)(turns, *more)
    rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    got = rounded(mine.select(numbered, *[c for c in mine.columns if c not in history.KEYS]))
    assert got and got == rounded(over(history_pairs(spark, folder), *more))


def test_texts_go_once(spark, folder):
    from quillet import catalog

    for name in ("ngram_clipped", "weighted_precision_multiref", "bleu4", "brevity_penalty"):
        plan = catalog.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_partitions_grow_with_the_texts(spark):
    df = spark.range(40).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert dealing.dealt(df, "id", F.col("t"), 5000).rdd.getNumPartitions() == 9
    assert dealing.dealt(df.where("false"), "id", F.col("t")).rdd.getNumPartitions() == 2
