"""Operators 3 and 7: rules and alignment against brute force."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quillet.llm import linedup, urls


def brute_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute_rule(host, path):
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return (best.text, best.verdict) if best else (None, None)


def test_urls(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    odd = [(1, None, None), (2, "", ""), (3, "no scheme", "x"), (None, "http://A.É.COM/en/x?y#z", None), (4, "a://b://c/d", ""), (5, "http://com/en/", ""), (5, "http://com/en/", ""), (6, "http://xcom/en/", ""), (7, "x://example.com/en/78#", None), (8, "x://é\nb.net/de/8", ""), (9, "http://" + "free" * 3000 + ".org/es/\n", "<p>free</p>")]
    both = pages.select("page_id", "url", "html").unionAll(spark.createDataFrame(odd, "page_id long, url string, html string")).withColumn("row", F.lit(1)).withColumn("token", F.lit(""))
    got = sorted(map(tuple, urls.url_verdicts(both).select("page_id", "url", "host", "path", "rule", "verdict").collect()), key=repr)
    rows = both.collect()
    assert len(got) == len(rows)
    for page, url, host, path, rule, verdict in got:
        assert (host, path) == brute_url(url), (page, url)
        want = brute_rule(host, path)
        assert rule == want[0] and verdict in ("allow", "block") and (want[1] is None or verdict == want[1])
    assert urls.url_verdicts(both.limit(0)).count() == 0


def test_segmentation_and_bayes(spark):
    text = "<p>" + "cheap pills online free bets poker the garden news " * 30 + "</p>"
    rows = [(i, f"http://cheappills{'online' * (i % 2)}.com/en/{i}", text) for i in range(40)] + [(100 + i, f"http://gardennews.net/de/{i}", text) for i in range(40)]
    rows += [(200, "http://freecheappills.info/x", text), (201, "http://thegarden.info/x", text)]
    got = {r.page_id: r.verdict for r in urls.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[200] == "block" and got[201] == "allow"
    words = urls.segment_labels(spark.createDataFrame([("freecheappills",), ("zzq",)], "label string"), urls.unigrams(spark.createDataFrame([(text,)], "html string")))
    assert {r.label: list(r.words) for r in words.collect()}["freecheappills"] == ["free", "cheap", "pills"]


def brute_text(html):
    html, out, at = (html or "").lower(), [], 0
    while at < len(html):
        m = re.compile(r"<(script|style)\\b").search(html, at)
        if not m:
            break
        out.append(html[at : m.start()])
        following = re.compile(r"<(script|style)\\b").search(html, m.end())
        end = html.find(f"</{m[1]}", m.end(), following.start() if following else len(html))
        at = m.start() if end < 0 else end
        if end < 0:
            out.append(" " + html[at : following.start() if following else len(html)])
            at = following.start() if following else len(html)
        else:
            stop = following.start() if following else len(html)
            out.append(" <" + html[end + len(m[1]) + 2 : stop])
            at = stop
    out.append(html[at:])
    return re.sub(r"<[^<>]*>", " ", "".join(out))


def brute_split(label, p, total):
    """The best of all splits, by recursion over the last word."""
    import functools

    @functools.cache
    def best(end):
        if not end:
            return 0.0, ()
        out = (-math.inf, ())
        for start in range(end):
            w = label[start:end]
            score = best(start)[0] + p.get(w, 1 - math.log10(max(total, 10.0)) - len(w))
            if score > out[0] + 1e-12:
                out = (score, (*best(start)[1], w))
        return out

    return list(best(len(label))[1])


def brute_verdicts(pages):
    """page_id -> (verdict, score) by counting words, splitting hosts and multiplying probabilities."""
    words = Counter(w for _, _, html in pages for w in re.findall(r"[^\W\d_]{2,}", brute_text(html)))
    total = sum(words.values())
    p = {w: math.log10(n / total) for w, n in words.items()}
    rows = []
    for page, url, _ in pages:
        host, path = brute_url(url)
        tokens = ["h:" + w for label in re.split(r"[^\w]+|_", host) if label for w in brute_split(label, p, total)]
        tokens += ["p:" + x for x in re.split(r"[^a-zà-öø-ÿ#]+", re.sub("[0-9]+", "#", path.lower())) if x]
        rows.append((page, brute_rule(host, path)[1], tokens))
    n = {v: Counter(t for _, r, ts in rows if r == v for t in ts) for v in ("block", "allow")}
    kinds = len(set(n["block"]) | set(n["allow"]))
    docs = Counter(r for _, r, _ in rows)
    prior = math.log((docs["block"] + 1) / (docs["allow"] + 1)) if docs["block"] and docs["allow"] else 0.0
    out = {}
    for page, ruled, tokens in rows:
        seen = [t for t in tokens if t in n["block"] or t in n["allow"]]
        score = prior + sum(math.log((n["block"][t] + 1) / (sum(n["block"].values()) + kinds + 1)) - math.log((n["allow"][t] + 1) / (sum(n["allow"].values()) + kinds + 1)) for t in seen)
        out[page] = (ruled or ("block" if score > 0 else "allow"), None if ruled else score)
    return out


def test_verdicts_against_brute_force(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    text = "<p>" + "cheap pills online free bets poker the garden news " * 5 + "</p><script>var x = '<b>pills'</script><style>p {}"
    pages += [(10_000 + i, f"http://{'cheap' * (i % 2)}pills{'online' * (i % 3)}.com/{('en', 'xx')[i % 2]}/{i}", text) for i in range(20)]
    pages += [(20_000 + i, f"http://garden{'news' * (i % 2)}.net/de/{i}", None) for i in range(20)]
    pages += [(30_000, "http://thefreepillsnews.info/en/1", "<<<<"), (30_001, "http://qqzz.info/", "a > b < c"), (30_002, None, None)]
    got = {r.page_id: (r.verdict, r.score) for r in urls.url_verdicts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = brute_verdicts(pages)
    assert set(got) == set(want)
    for page, (verdict, score) in want.items():
        assert got[page][0] == verdict and (score is None) == (got[page][1] is None), page
        assert score is None or math.isclose(got[page][1], score, abs_tol=1e-9), page
    assert any(s is not None for _, s in want.values())


def test_text_of_open_tags_is_linear(spark):
    import time

    html = ["<script " * 60_000, "<" * 300_000, "<style>" * 40_000 + "</style>", "<script>a<b</script>word<style>x</style> tail <i"]
    df = spark.createDataFrame(list(enumerate(html)), "i int, html string")
    began = time.perf_counter()
    got = {r.i: r.t for r in df.select("i", urls.visible_text(F.col("html")).alias("t")).collect()}
    assert time.perf_counter() - began < 20 and got[3].split() == ["word", "tail", "<i"]


def test_patience():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.randrange(12) for _ in range(rnd.randrange(25))] for _ in range(2))
        m = linedup.patience_matches(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:], strict=False))
    assert linedup.patience_matches([1, 2, 3, 9, 4], [7, 1, 2, 3, 4]) == [(0, 1), (1, 2), (2, 3), (4, 4)]


def line(key, n):
    return " ".join(f"{key}{k}" for k in range(n))


def test_worker_streams():
    """Lines whose rows come in batches of any size give the same pairs and frequent rows; copies take no part."""
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(9)
    rows = set()
    for name in range(30):
        for _ in range(rnd.choice((1, 2, 5, 9, 40))):
            doc = rnd.randrange(60)
            rows.add((name, 1000 + doc % 45, doc, rnd.randrange(2)))  # documents 45 to 59 are copies of 0 to 14
    rows = np.array(sorted([*rows, *rnd.sample(sorted(rows), 40)]), np.int64)  # some rows stand twice
    want_pairs, want_often = set(), set()
    for name in range(30):
        mine = sorted({tuple(r) for r in rows.tolist() if r[0] == name})
        lead = {c: min(r[2] for r in mine if r[1] == c) for c in {r[1] for r in mine}}
        mine = [r for r in mine if r[2] == lead[r[1]]]
        if len(mine) > 8:
            want_often |= {(name, r[2], r[1] ^ r[2], r[3]) for r in mine}
        else:
            want_pairs |= {(x[2], x[1] ^ x[2], x[3], y[1] ^ y[2], y[3]) for x in mine for y in mine if x[2] < y[2]}
    for size in (1, 3, 7, 50, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in rows[i : i + size].T], list(linedup.LINE_COLUMNS)) for i in range(0, len(rows), size)]
        got = [r for b in linedup.pair_worker(8)(iter(batches)) for r in b.to_pylist()]
        assert {tuple(r.values())[1:] for r in got if r["line"] is None} == want_pairs
        assert {(r["line"], r["oid"], r["key"], r["sec"]) for r in got if r["line"] is not None} == want_often
    assert want_pairs and want_often


def test_common_blocks(monkeypatch):
    """Blocks are exactly the windows that both hold, in any order and however often."""
    import numpy as np

    rnd = random.Random(5)
    for _ in range(300):
        pool = [[rnd.randrange(1, 1 << 32) for _ in range(rnd.randrange(5, 40))] for _ in range(5)]
        a, b = ([x for _ in range(rnd.randrange(6)) for x in [*rnd.choice(pool), *(rnd.randrange(1, 1 << 32) for _ in range(rnd.randrange(3)))]] for _ in range(2))
        have = {tuple(a[i : i + 20]) for i in range(len(a) - 19)}
        want = {k for i in range(len(b) - 19) if tuple(b[i : i + 20]) in have for k in range(i, i + 20)}
        got = linedup.common_blocks(np.array(a, np.uint64), np.array(b, np.uint64), 20)
        assert {k for s, e in got for k in range(s, e)} == want


def brute_spans(rows, passage):
    """Of every document the words in windows that an earlier one holds."""
    seen, want = set(), {}
    for d, t in sorted(rows):
        w = (t or "").split()
        own = [tuple(w[i : i + passage]) for i in range(len(w) - passage + 1)]
        want[d] = {k for i, x in enumerate(own) if x in seen for k in range(i, i + passage)}
        seen.update(own)
    return want


def check_spans(df, rows, **sizes):
    want, text = brute_spans(rows, sizes.get("passage", linedup.PASSAGE)), dict(rows)
    got = {r.doc_id: r for r in linedup.removed_spans(df, **sizes).collect()}
    clean = {r.doc_id: r.clean_text for r in linedup.dedup_lines(df, **sizes).collect()}
    assert len(got) == len(rows) == len(clean)
    for d, r in got.items():
        words = text[d].split()
        assert {k for s, e in r.spans for k in range(s, e)} == want[d], d
        assert r.removed_words == len(want[d]) and r.n_words == len(words)
        assert bool(r.sources) == bool(want[d]) and all(x < d for x in r.sources)
        assert clean[d].split() == [w for k, w in enumerate(words) if k not in want[d]]
        assert want[d] or clean[d] == text[d]
    return want


def passages(rnd, docs):
    """Documents of own words and parts of shared passages: two of them in few documents, four in many; also copies and near copies."""
    pool = [line(f"q{i}x", 130).split() for i in range(6)]
    rows = []
    for d in range(docs):
        words = []
        for k in range(rnd.randrange(1, 5)):
            words += line(f"own{d}x{k}x", rnd.randrange(1, 30)).split()
            p, at = pool[rnd.randrange(6) if d % 9 == 0 else rnd.randrange(2, 6)], rnd.randrange(70)
            words += p[at : at + rnd.randrange(20, 131)]
        words += line(f"end{d}x", 5).split()
        if rows and d % 7 == 0:
            words = rnd.choice(rows)[1].split()
        if rows and d % 7 == 1:
            words = rnd.choice(rows)[1].split()
            words[len(words) // 2] = f"edit{d}"
        rows.append((d, "".join(w + rnd.choice(("\n", "  ", *[" "] * 40)) for w in words)))
    return rows


def test_line_dedup(spark, docs, sf_docs, odd, none):
    """Repeated passages go wherever lines end and whoever else holds parts of them: exactly the windows an earlier document holds."""
    rows = passages(random.Random(4), 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("clean_text", F.lit("old")).repartition(4)
    want = check_spans(df, rows)
    assert any(want.values()) and not all(want.values())
    # shorter passages are a matter of the parameters
    assert sum(map(len, check_spans(df, rows, passage=12, line=6).values())) > sum(map(len, want.values()))
    check_spans(docs, [(d["doc_id"], d["text"]) for d in sf_docs])
    assert linedup.removed_spans(odd).count() == odd.count() and linedup.removed_spans(none).count() == 0
    assert linedup.dedup_lines(odd).columns == [*odd.columns, "clean_text"] and linedup.dedup_lines(odd).count() == odd.count()


def test_long_documents(spark, monkeypatch):
    """Passages across the borders of sections."""
    monkeypatch.setattr(linedup, "SECTION", 130)
    rnd = random.Random(8)
    p = line("p", 300).split()
    rows = [(d, " ".join([*line(f"a{d}x", rnd.randrange(400)).split(), *p[(at := rnd.randrange(150)) : at + rnd.randrange(40, 300)], *line(f"b{d}x", rnd.randrange(400)).split()])) for d in range(24)]
    assert any(check_spans(spark.createDataFrame(rows, "doc_id long, text string"), rows).values())


def test_repeated_rows(spark):
    """Of equal rows the first keeps its text; short ones stay; null ids come last."""
    a, b = line("a", 80), line("b", 20)
    rows = [(1, a, "x"), (1, a, "y"), (2, b, "x"), (2, b, "x"), (None, a, "z"), (None, line("c", 60), "z"), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r.clean_text) for r in linedup.dedup_lines(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (1, ""), (2, b), (2, b), (None, ""), (None, line("c", 60)), (3, None)], key=repr)
    assert sorted((r.removed_words, r.sources) for r in linedup.removed_spans(df).collect()) == [(0, []), (0, []), (0, []), (0, []), (0, []), (80, [1]), (80, [1])]


def test_short_lines_go_from_later_documents(spark):
    note, other = "all rights reserved by us", "only   one\tdocument says  this"
    rows = [(i, f"own{i} a b c d e f g\n{note}\nx{i} y z\n  {note} ", "s") for i in range(9, 0, -1)]
    rows += [(20, f"{other}\n{other}", "s"), (21, "only one document says this", "s"), (22, None, "s"), (23, "", "s"), (None, f"{note}\nrest", "s"), (3, f"{note}\nanother text of the id three", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 string")
    got = sorted((r.doc_id if r.doc_id is not None else 99, sorted((s.start, s.end) for s in r.spans), sorted(r.sources)) for r in linedup.removed_spans(docs, whole_lines=5).collect())
    spans = [(8, 13), (16, 21)]
    want = [(1, [], [])] + [(i, spans, [1]) for i in range(2, 10)] + [(3, [(0, 5)], [1]), (20, [], []), (21, [(0, 5)], [20]), (22, [], []), (23, [], []), (99, [(0, 5)], [1])]
    assert got == sorted(want)
    clean = {r.doc_id: r.clean_text for r in linedup.dedup_lines(docs, whole_lines=5).where("doc_id <> 3").collect()}
    assert clean[2] == "own2 a b c d e f g\nx2 y z" and clean[1] == rows[8][1] and clean[21] == "" and clean[22] is None
    assert all(not r.spans for r in linedup.removed_spans(docs).collect())
    assert linedup.removed_spans(docs.where("false"), whole_lines=5).count() == 0


def test_a_line_that_a_third_of_all_documents_hold(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("the very same words again\nown "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("nothing shared here at all "), F.col("id").cast("string"))).alias("text"))
    got = linedup.removed_spans(docs, whole_lines=5).where("removed_words > 0")
    assert got.count() == 1999 and got.where("removed_words <> 5 or sources[0] <> 0").count() == 0
