"""Items of pairs are counted where they are: no table of all items is grouped, against a brute-force count."""

import random
from collections import Counter

from quillet.operators import multiset, scores


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def random_pairs(spark, n=60):
    r = random.Random(4)
    words = ["a", "b", "é", "if", "x1", "(", "//", "\n", "a_b"]
    said = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 30)))
    rows = [(i, [said() for _ in range(r.randint(0, 4))], said()) for i in range(n)] + [(n, None, None), (n + 1, [None, "a"], "a a")]
    return spark.createDataFrame(rows, "pair_id long, refs array<string>, hyp string")


def test_clipped_items_against_counters(spark):
    tokens = multiset.tokenised(random_pairs(spark))
    want = {}
    for row in tokens.collect():
        grams = lambda t: Counter((n, " ".join(t[i : i + n])) for n in range(1, 5) for i in range(len(t) - n + 1))
        own, refs = grams(row.h), [grams(t) for t in row.rs]
        want |= {(row.pair_id, *k): (c, min(c, max([r[k] for r in refs], default=0))) for k, c in own.items()}
        if not own:
            want[row.pair_id, None, None] = (0, 0)
    got = multiset.clipped_items(tokens, multiset.gram_items(4)).collect()
    assert len(got) == len(want) and {(r.pair_id, r.kind, r["item"]): (r.n, r.common) for r in got} == want


def test_no_grouping_by_item(spark):
    """What is grouped is sums of a pair; a grouping by item held some hundred times the text in memory and spilled it."""
    pairs = random_pairs(spark, 3)
    for df in (multiset.weighted_precision(pairs, ("if",)), multiset.gram_clip(pairs), scores.composite(pairs, "dart"), scores.score_detected(pairs)):
        assert not [x for x in plan_of(df).split("\n") if "Aggregate [" in x and "item" in x.split("],")[0]]
