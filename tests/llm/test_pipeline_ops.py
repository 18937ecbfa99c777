"""Operators 1, 8, 9 and 10 against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from quillet.llm import decontam, mixing, quality, simhash

SPACE = "[^\x20\x09-\x0d]+"


def rows_of(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


def brute_print(text, size=4):
    words = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, prints, bits=4):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(set(prints))
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= bits:
                parent[root(a)] = root(b)
    least = {}
    for d, p in zip(ids, prints, strict=True):
        r = root(p)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [least[root(p)] for p in prints]


def check_simhash(df, rows):
    prints = [brute_print(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], brute_components([r[0] for r in rows], prints), strict=True), key=repr)
    assert rows_of(simhash.near_duplicates(df, words_per_shingle=4), "doc_id", "fingerprint", "component_id") == want


def test_simhash(docs, sf_docs, odd, odd_rows, none):
    check_simhash(docs, [(d["doc_id"], d["text"]) for d in sf_docs])
    check_simhash(odd, odd_rows)
    assert simhash.near_duplicates(none).count() == 0
    assert [simhash.most_bits(x) for x in ((3, 1), (4, 1), (5, 2), (6, 3))] == [5, 7, 4, 4]
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs, bits=6)


def test_simhash_dense_groups_and_layouts(spark):
    """Chains and balls of fingerprints: every layout, and buckets too large for a task, give the components of brute force."""
    import random

    rnd = random.Random(5)
    prints = set()
    for _ in range(12):
        at = rnd.getrandbits(64)
        for _ in range(25):
            prints.add(at)
            for _ in range(rnd.choice((1, 2, 3, 4, 5))):
                at ^= 1 << rnd.randrange(64)
    centre = rnd.getrandbits(64)
    prints |= {centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    prints |= {(centre & ~((1 << 21) - 1)) | rnd.getrandbits(21) for _ in range(60)}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    for bits, layout, held in ((4, (3, 1), 20_000), (5, (3, 1), 3), (4, (5, 2), 20_000), (4, (6, 3), 20_000)):
        want = brute_components(prints, prints, bits)
        got = {(r.node % (1 << 64)): r.root % (1 << 64) for r in simhash.print_components(df, bits, layout, held).collect()}
        groups = defaultdict(set)
        for p, w in zip(prints, want, strict=True):
            groups[w].add(got.get(p, p))
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_simhash_bucket_of_many_components(spark):
    """5,000 unrelated fingerprints share a segment, some in linked pairs: one bucket a task compares, or salted parts do."""
    import random

    rnd = random.Random(6)
    low = rnd.getrandbits(21)
    apart = {rnd.getrandbits(43) << 21 | low for _ in range(5000)}
    near = [p ^ (1 << rnd.randrange(21, 64)) ^ (1 << rnd.randrange(21, 64)) ^ (1 << rnd.randrange(21)) for p in sorted(apart)[:40]]
    prints = sorted(apart | set(near))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    for held in (20_000, 100):
        got = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.print_components(df, held=held).collect()}
        assert all(got.get(p, p) == got.get(q, q) for p, q in zip(sorted(apart), near, strict=False))
        assert len(got) == len(near)


def test_keep_one_per_group(docs, sf_docs, odd, none):
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    comps = set(brute_components([d["doc_id"] for d in sf_docs], [brute_print(d["text"], 5) for d in sf_docs]))
    assert {r.doc_id for r in kept.collect()} == comps and kept.count() == len(comps)
    assert [r.doc_id for r in simhash.keep_one_per_group(odd).where("doc_id in (4, 5)").collect()].count(5) == 0
    assert simhash.keep_one_per_group(none).count() == 0


def test_keep_one_per_group_without_ids(spark):
    """Unrelated texts without a doc_id are groups of their own; copies among them go."""
    texts = [" ".join(f"t{i}w{k}" for k in range(60)) for i in range(3)]
    rows = [(None, t) for t in (*texts, texts[0])] + [(1, texts[2])]
    kept = simhash.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(kept, "doc_id", "text") == sorted([(None, texts[0]), (None, texts[1]), (1, texts[2])], key=repr)


def brute_quality(text):
    text = text or ""
    words, seen, dup = re.findall(SPACE, text), set(), 0
    for line in text.split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def check_quality(df, rows):
    want = sorted(((r[0], *brute_quality(r[1])) for r in rows), key=repr)
    got = quality.quality_verdicts(df)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    return got


def test_quality(docs, sf_docs, odd, odd_rows, none):
    check_quality(docs, [(d["doc_id"], d["text"]) for d in sf_docs])
    check_quality(odd, odd_rows)
    assert quality.quality_verdicts(none).count() == 0 and quality.clean_documents(none).count() == 0
    kept = quality.clean_documents(odd)
    assert kept.columns == odd.columns and all(not brute_quality(r.text)[-1] for r in kept.collect())


def brute_lines(rows, limits):
    """(removed_words, depleted, clean text) of each row (doc_id, text, source), by hosts."""
    norm = lambda x: re.sub(r"[\x20\x09-\x0d]+", " ", x).strip(" ").lower()
    lines = lambda t: [x for x in (t or "").split("\n") if re.search(SPACE, x)]
    holders, hosts, out = defaultdict(set), defaultdict(set), []
    for _, t, s in rows:
        mine = [norm(x) for x in lines(t)]
        hosts[s].add(tuple(mine))
        for x in mine:
            holders[s, x].add(tuple(mine))
    bad = {k for k, v in holders.items() if len(v) > limits.max_line_docs and len(v) > limits.max_line_share * len(hosts[k[0]])}
    for _, t, s in rows:
        gone = sum(len(re.findall(SPACE, x)) for x in lines(t) if (s, norm(x)) in bad)
        clean = t if not gone else "\n".join(x for x in t.split("\n") if (s, norm(x)) not in bad)
        out.append((gone, gone > limits.max_removed_share * len(re.findall(SPACE, t or "")), clean))
    return out


def check_lines(df, rows, limits):
    """Verdicts and cleaned documents; returns the kept rows."""
    want = brute_lines(rows, limits)
    failed = [brute_quality(r[1])[-1] for r in rows]
    got = quality.quality_verdicts(df, limits)
    verdicts = sorted(((r[0], w[0], w[1], not f and not w[1]) for r, w, f in zip(rows, want, failed, strict=True)), key=repr)
    assert rows_of(got, "doc_id", "removed_words", "depleted", "kept") == verdicts
    clean = quality.clean_documents(df, limits)
    assert clean.columns == df.columns
    kept = sorted(((r[0], w[2], r[2]) for r, w, f in zip(rows, want, failed, strict=True) if not f and not w[1]), key=repr)
    assert rows_of(clean, "doc_id", "text", "source") == kept
    return kept, want


def test_boilerplate(spark):
    """A line in many documents of a host is boilerplate there only; copies of a document are no reason."""
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    line = " ".join(f"boiler{k}" for k in range(80))
    rows = [(i, f"{own(i, 60)}\n{line}", "a") for i in range(40)]  # depleted: 80 of 140 words
    rows += [(100 + i, f"{own(100 + i, 90)}\n{line}\n{own(900 + i, 90)}", "a") for i in range(40)]  # keeps 180 of 260
    rows += [(200 + i, f"{own(200 + i, 60)}\n{line}", "b") for i in range(9)]
    rows += [(300 + i, f"{own(7777, 60)}\n{own(8888, 60)}", "a") for i in range(50)]  # exact copies
    rows += [(100, f"{own(100, 90)}\n{line}\n{own(900, 90)}", "b"), (500, f"{line}\n{own(3, 70)}", None)]  # the same row on another host
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    kept, want = check_lines(df, rows, quality.QualityLimits())
    assert {r[0] for r in kept} == {r[0] for r in rows} - set(range(40)) and (100, rows[40][1], "b") in kept
    clean = quality.clean_documents(df)
    assert clean.where("n_chars <> length(text)").isEmpty()


def test_depleted_documents_of_many_common_lines(spark):
    """200 documents of 20 lines that all share and one of their own."""
    rows = [(d, "\n".join([*(" ".join(f"s{i}x{k}" for k in range(10)) for i in range(20)), " ".join(f"own{d}x{k}" for k in range(10))]), "a") for d in range(200)]
    kept, want = check_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), rows, quality.QualityLimits())
    assert not kept and all(w[0] == 200 for w in want)


def test_boilerplate_counts_are_exact(spark):
    """Random documents of several common lines, copies, also by case and spaces, repeated and null rows, several hosts."""
    import random

    rnd = random.Random(3)
    pool = [" ".join(f"s{i}x{k}" for k in range(12)) for i in range(8)]
    rows = []
    for d in range(150):
        lines = sorted(rnd.sample(pool, rnd.choice((2, 4, 6))))
        if d % 3:
            lines += [f"own {d % 50}", " ".join(f"o{d}x{k}" for k in range(rnd.randrange(20, 90)))]
        source = rnd.choice(("a", "a", "b", None))
        rows.append((d, "\n".join(lines), source))
        rows.append((1000 + d, "\n".join(x.upper().replace(" ", "  ") for x in lines), source))
    rows += [(2000, None, "a"), (2001, "", None), (None, rows[4][1], "a"), rows[7], rows[7]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    several = set()
    for limits in (quality.QualityLimits(), quality.QualityLimits(max_line_docs=12), quality.QualityLimits(max_line_docs=8, max_line_share=0.2)):
        several |= {w[0] for w in check_lines(df, rows, limits)[1]}
    assert len(several) > 5


def brute_leaks(docs, items):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    sizes = {len(w) for w in windows}
    for d, t in docs:
        w, hit, ids = cut(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= found
        listed = sorted(str(i) for i in ids if i is not None)
        yield d, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, docs, sf_docs, odd, odd_rows, none, sf):
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [tuple(r) for r in bench.collect()]
    want = sorted(brute_leaks([(d["doc_id"], d["text"]) for d in sf_docs], items), key=repr)
    assert rows_of(decontam.contamination(docs, bench), *names) == want
    assert any(w[2] for w in want)
    assert {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()} == {w[0] for w in want if not w[2]}
    text = sf_docs[0]["text"]
    odd_items = [(1, "x"), (2, None), (3, ""), (None, "w1 w2 w3"), (3, " ".join(text.split()[5:30])), (3, "ÜnÏ École"), (4, "Üni école"), (1, "x"), (77, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")]
    odd_bench = spark.createDataFrame(odd_items, "item_id long, text string").withColumn("words", F.lit(1))
    assert rows_of(decontam.contamination(odd, odd_bench), *names) == sorted(brute_leaks([r[:2] for r in odd_rows], odd_items), key=repr)
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(docs.select("doc_id", "text"), odd_bench.limit(0)).count() == len(sf_docs)


def test_items_of_common_words(spark, monkeypatch):
    """Windows of the commonest words, repeated words and items of one word, with broadcast and with dealt tables of terms."""
    import random

    rnd = random.Random(7)
    word = lambda: rnd.choice("aa aa aa bb bb cc dd".split())
    rows = [(d, " ".join(word() for _ in range(rnd.choice((3, 12, 60, 200))))) for d in range(60)]
    items = [(i, " ".join(word() for _ in range(rnd.choice((1, 2, 9, 10, 11, 14))))) for i in range(40)] + [(90, "aa aa aa aa aa aa aa aa aa aa"), (91, "zz"), (92, "aa zz")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute_leaks(rows, items), key=repr)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert any(w[3] > 3 for w in want)
    for limit in (decontam.BROADCAST_ROWS, 0):
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
        assert rows_of(decontam.contamination(docs, bench), *names) == want


def brute_near(rows, items, slop, terms):
    """(doc_id, item_id) where some stretch of fewer than slop + 1 words from the rarest term's places holds all terms."""
    cut = lambda t: t.split()
    count = Counter(w for _, t in rows for w in cut(t))
    out = set()
    for i, t in items:
        ranked = sorted((count[w], w) for w in set(cut(t)) if count[w])[:terms]
        names = [w for _, w in ranked]
        if len(names) < 2:
            continue
        for d, text in rows:
            w = cut(text)
            for c in (p for p, x in enumerate(w) if x == names[0]):
                if any(set(names) <= set(w[s : s + slop]) for s in range(max(0, c - slop + 1), c + 1)):
                    out.add((d, i))
    return out


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "aa filler bb filler cc"), (2, "cc aa bb"), (3, "aa " + "x " * 40 + "bb cc"), (4, "aa bb")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "aa bb cc")], "item_id long, text string")
    near = decontam.proximity_matches(decontam.Index(docs, bench), slop=10)
    ids = docs.select("doc_id", decontam.doc_key(docs).alias("doc"))
    assert rows_of(near.join(ids, "doc"), "doc_id", "item_id", "first", "last") == [(1, 9, 0, 4), (2, 9, 0, 2)]


def test_proximity_against_brute_force(spark):
    import random

    rnd = random.Random(11)
    names = [f"w{i}" for i in range(12)]
    rows = [(d, " ".join(rnd.choice(names) if rnd.random() < 0.25 else "filler" for _ in range(rnd.randrange(120)))) for d in range(60)]
    items = [(i, " ".join(rnd.sample(names, rnd.choice((1, 2, 3, 5))))) for i in range(20)] + [(50, "none here w1")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ids = docs.select("doc_id", decontam.doc_key(docs).alias("doc"))
    for slop, terms in ((8, 3), (20, 3), (15, 2), (20, 4)):
        got = {(r.doc_id, r.item_id) for r in decontam.proximity_matches(decontam.Index(docs, bench), slop, terms).join(ids, "doc").collect()}
        assert got == brute_near(rows, items, slop, terms), (slop, terms)


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else share[s] for s in order}
        full |= over


def check_mix(df, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall(SPACE, r[1] or ""))
    got, want = mixing.mix_counts(df).collect(), brute_targets(sizes)
    assert len(got) == len(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    return taken, largest, want


def test_mixing(docs, sf_docs, odd, odd_rows, none):
    rows = [(d["doc_id"], d["text"], d["lang"], d["source"]) for d in sf_docs]
    taken, largest, want = check_mix(docs, rows)
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in want)
    assert sum(taken.values()) <= sum(want.values()) < sum(taken.values()) + 2 * max(largest.values())
    again = rows_of(mixing.mix_counts(docs.repartition(7)), "doc_id", "taken")
    assert again == rows_of(mixing.mix_counts(docs), "doc_id", "taken")
    check_mix(odd, odd_rows)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == mixing.mix_counts(odd).agg(F.sum("times")).first()[0]
    assert Counter(r.doc_id for r in mixing.mix(docs).collect()) == Counter({r.doc_id: r.times for r in mixing.mix_counts(docs).collect() if r.times})
    assert mixing.mix_counts(none).count() == 0 and mixing.mix(none).count() == 0


def test_mix_repeated_rows(spark):
    """Equal rows stand together as often as they are taken, in each source apart."""
    rows = [(i // 3, " ".join(f"w{i // 3}x{k}" for k in range(5 + i // 3)), source) for source in ("a", "b", None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("k_source", F.lit("extra"))
    mixed = mixing.mix(df)
    got = Counter((r.doc_id, r.source) for r in mixed.collect())
    want = Counter()
    for r in mixing.mix_counts(df).collect():
        want[r.doc_id, r.source] += r.times
    assert mixed.columns == df.columns and got == +want and len(set(got.values())) > 1
    # rows that differ in other columns only are rows of their own: none stands in for another
    extra = spark.createDataFrame([(1, "a b c", "s", f"x{i}") for i in range(40)] + [(2, "d e", "t", "y")] * 9, "doc_id long, text string, source string, lang string")
    got = Counter(r.lang for r in mixing.mix(extra.repartition(4)).collect())
    assert got["y"] == 18 and sum(got.values()) - 18 == sum(r.times for r in mixing.mix_counts(extra).collect() if r.doc_id == 1)
    assert sum(got.values()) - 18 >= 40 and all(1 <= got[f"x{i}"] <= 2 for i in range(40))


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, None: 5}, {"a": 0}, {"é": 7, "z": 7, "A": 7, "b": 1}, {f"s{i}": i * i for i in range(30)}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = brute_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes), (got, want)


def test_few_texts_are_dealt_out(spark, docs):
    rows = spark.range(40_000).select(F.xxhash64("id").alias("k"), F.lit("text").alias("text"), F.lit("x").alias("bucket"), F.lit("y").alias("slot"))
    keys = rows.where("k % 97 = 0").select("k")
    for bits in (27, 12):
        got = decontam.may_hold(rows, "k", keys, bits)
        assert got.columns == rows.columns and got.join(keys, "k").count() == keys.count()
        assert got.count() < (keys.count() + 40 if bits == 27 else 40_000)
    assert decontam.may_hold(rows, "k", keys.limit(0)).count() == 0
    plan = decontam.may_hold(docs.select(decontam.doc_key(docs).alias("k"), "text"), "k", keys)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(k" not in plan.split("BroadcastExchange")[0]


def test_quality_limit_ignores_copies_on_both_sides(spark):
    line = "all rights reserved by the owners of this page"
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    shared = [(i, f"{words(i)}\n{line}", "host") for i in range(40)]
    copies = [(1000 + i, words("copy"), "host") for i in range(30_000)]
    for rows in (shared, shared + copies):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = {r.doc_id: r.removed_words for r in quality.quality_verdicts(df).collect()}
        assert sum(got.values()) == 9 * 40 and all(got[i] == 9 for i in range(40))
