"""The pipeline against a brute-force version, every stage recomputed from its predecessor's rows."""

import hashlib
import math
import re
from collections import defaultdict

import corpus_pipeline
from quillet.llm import quality

from .test_pipeline_ops import SPACE, brute_components, brute_leaks, brute_lines, brute_print, brute_quality, brute_targets
from .test_tokens import brute


def brute_mix(rows):
    """Rows (doc_id, text, lang, source, n_chars) as often as weighted fair queueing takes them."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    each = sorted((md5(f"0:{r[0]}:{md5(r[1])}"), len(re.findall(SPACE, r[1])), r) for r in rows)
    sizes = defaultdict(int)
    for _, n, r in each:
        sizes[r[3]] += n
    target, upto, queue = brute_targets(sizes), defaultdict(int), []
    for h, n, r in each:
        upto[r[3]] += n
        if n:
            queue += [((upto[r[3]] + k * sizes[r[3]]) / target[r[3]], h, k, n, r) for k in (0, 1)]
    out, total, budget = [], 0, math.floor(1.5 * sum(sizes.values()))
    for *_, n, r in sorted(queue):
        total += n
        if total > budget:
            break
        out.append(r)
    return out


def test_pipeline(spark, sf, sf_docs):
    rows = [(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"]) for d in sf_docs]
    lines = brute_lines([(r[0], r[1], r[3]) for r in rows], quality.QualityLimits())
    left = [(r[0], text, r[2], r[3], len(text)) for r, (_, depleted, text) in zip(rows, lines, strict=True) if not depleted and not brute_quality(r[1])[-1]]
    assert 0 < len(left) < len(rows)
    comps = set(brute_components([r[0] for r in left], [brute_print(r[1], 5) for r in left]))
    left = [r for r in left if r[0] in comps]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {x[0] for x in brute_leaks([r[:2] for r in left], items) if not x[2]}
    left = [r for r in left if r[0] in clean]
    mixed = brute_mix(left)
    assert {len([x for x in mixed if x == r]) for r in left} == {0, 1, 2}
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=repr) == brute([r[:2] for r in mixed])


def test_stages_keep_columns(spark, odd, none, sf):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf).columns == docs.columns
            assert stage(spark, docs, sf).count() <= 2 * docs.count()
