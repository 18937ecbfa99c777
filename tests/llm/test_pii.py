"""Operator 2: base spans against plain leftmost matching; what the method adds; EM on known labelers."""

import hashlib
import math
import random
import re

import regex
from pyspark.sql import functions as F

from quillet.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    spans = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]
    return [sum(s[0] == k for s in spans) for k in PATTERNS], spans


def check(df, rows):
    got = sorted(map(tuple, pii.digest(pii.personal_data(df)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()), key=repr)
    want = []
    for d, text in rows:
        counts, spans = brute(text)
        want.append((d, *counts, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()))
    assert [g[:6] for g in got] == sorted(want, key=repr)
    return got


def test_base_spans(docs, sf_docs, odd, odd_rows, none):
    check(docs, [(d["doc_id"], d["text"]) for d in sf_docs])
    check(odd, [r[:2] for r in odd_rows])
    assert pii.personal_data(none).count() == 0


def test_hostile_texts(spark):
    rnd = random.Random(3)
    parts = ["a@b.c", "_d@e.f", "1.2.3.4", ".5.6.7.8", "256.1.1.1", "0001.2.3.004", "4111 1111 1111 1111", "4111111111111111", "+1 (582) 555-5777", "+", "@", ".", "-", " ", "9", "12", "é", "\U0001f600", "x", "\x01", "\x02", "\n", "a@b", "..", "+49 30 1234567.", "%"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(40)))) for i in range(400)]
    rows += [(1000, "a" * 8_000), (1001, "1." * 6_000), (1002, "a@" * 6_000), (1003, "a.b@c." * 3_000), (1004, "+1" + " " * 10_000), (1005, "1 " * 5_000), (1006, "x@y.z " * 1_000)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_added_spans_and_redaction(spark):
    rows = [(i, f"please call our phone 415-555-{1000 + i} or mail joe{i} [at] example.com now") for i in range(40)]
    rows += [(100 + i, f"contact a{i}@example.com, phone +1 (582) 555-{1000 + i}, password=abcdef0123456789{i:02d}") for i in range(40)]
    rows += [(200 + i, f"version 1.2.3.{900 + i} and order 1234-5678-9012-3456 are fine") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r.doc_id: r.spans for r in pii.digest(pii.personal_data(df)).collect()}
    assert all("phone:" in got[i] and "email:" in got[i] for i in range(40))
    assert all("secret:" in got[100 + i] for i in range(40)) and not any(got[200 + i] for i in range(40))
    clean = {r.doc_id: r.clean_text for r in pii.redact(df.withColumn("clean_text", F.lit("old"))).collect()}
    assert clean[100] == "contact <email>, phone <phone>, <secret>" and clean[0] == "please call our phone <phone> or mail <email> now" and clean[200] == rows[80][1]


def test_added_spans_have_precision_and_recall(spark):
    """Planted personal data that the base does not see, among look-alikes: both at least 0.9 over all kinds."""
    rnd = random.Random(12)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    words = "the of and report garden river north table seven which under paper".split()
    filler = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randrange(3, 30)))
    good = [
        lambda: (f"please call our phone {rnd.randrange(200, 999)}-{rnd.randrange(200, 999)}-{digits(4)}", "phone", 22),
        lambda: (f"my mobile is ({rnd.randrange(200, 999)}) {rnd.randrange(200, 999)}-{digits(4)}", "phone", 13),
        lambda: (f"contact jo{digits(3)} [at] example{rnd.randrange(9)}.com", "email", 8),
        lambda: (f"write to ann{digits(2)}(at)mail(dot)org", "email", 9),
        lambda: (f"the login password={'a1b2c3d4' + digits(6)}", "secret", 10),
    ]
    bad = [lambda: f"order {digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}", lambda: f"version {rnd.randrange(300, 999)}.2.3.4", lambda: f"page {digits(3)} of {digits(3)}", lambda: f"in {digits(4)} and {digits(4)}"]
    rows, want = [], set()
    for d in range(600):
        lead = filler() + " "
        if d % 2:
            text, kind, at = rnd.choice(good)()
            want.add((d, kind, len(lead) + at))
        else:
            text = rnd.choice(bad)()
        rows.append((d, f"{lead}{text} {filler()}"))
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.explode("spans").alias("s")).collect()
    found = {(r.doc_id, pii.KINDS[r.s.kind], r.s.start) for r in got if not r.s.base}
    hits = found & want
    assert len(hits) >= 0.9 * len(want) and len(hits) >= 0.9 * len(found), (len(hits), len(want), len(found), sorted(found - want)[:5], sorted(want - found)[:5])


def test_long_spans_are_found_whole(spark):
    secret, name, parts = "aB3" * 400, "n" * 300, ".x" * 50
    rows = [(i, f"the login password={secret}{i} end") for i in range(20)] + [(100 + i, f"write to {name}{i} [at] example{parts}.org now") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.clean_text for r in pii.redact(df).collect()}
    assert all(clean[i] == "the login <secret> end" and clean[100 + i] == "write to <email> now" for i in range(20))
    assert pii.redact(df.where("false")).count() == 0


def test_redaction_of_odd_rows(odd, odd_rows):
    got = pii.redact(odd)
    assert got.columns == [*odd.columns, "clean_text"]
    rows = got.collect()
    assert len(rows) == len(odd_rows) and all(r.clean_text == "" for r in rows if not r.text)
    assert all("<email>" in r.clean_text and "<ip>" in r.clean_text for r in rows if r.doc_id == 8)


def test_em_finds_reliabilities(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(4000):
        y = rnd.random() < 0.4
        rows.append((i, 0, [int(y) if rnd.random() < a else int(not y) if rnd.random() < 0.9 else -1 for a in (0.95, 0.85, 0.75, 0.6)]))
    found = pii.reliabilities(spark.createDataFrame(rows, "row long, kind int, votes array<int>"), 40).first()
    assert abs(found.pi - 0.4) < 0.05 and found.a[0] > 0.9 and found.a[0] > found.a[1] > found.a[2] > found.a[3]


def brute_candidates(text):
    """Dicts of all candidates of a text, by plain searches."""
    out = []
    for kind, loose, pattern in [(k, False, p) for k, (_, p) in pii.BASE.items()] + [(k, True, p) for k, _, p in pii.LOOSE]:
        matches = list(regex.finditer(pattern, text))
        ends = [0, *(m.end() for m in matches)]
        starts = [*(m.start() for m in matches), len(text)]
        for i, m in enumerate(matches):
            k, match, digits = pii.KINDS.index(kind), m[0], re.sub("[^0-9]", "", m[0])
            base = not loose and {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in match.split(".")), "card": lambda: 13 <= len(digits) <= 19 and brute_luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            around = text[ends[i] : m.start()][-40:] + " " + text[m.end() : starts[i + 1]][:40]
            says = lambda table, value: next((v for v, p in ((1, table[kind][0]), (0, table[kind][1])) if p and regex.search(p, value)), -1)  # noqa: E731, B023
            variety = len(set(digits)) if digits else 1
            votes = [1 if base or loose and kind != "phone" else -1 if loose else 0, says(pii.GAZETTEER, digits if kind == "card" else match), says(pii.CONTEXT, around)]
            votes.append(-1 if kind in ("email", "secret") else 1 if variety >= 4 else 0 if variety <= 2 else -1)
            features = [min(32, x) for x in (min(len(match), 48) // 3, min(len(digits), 20), sum(c in " -().@" for c in match), votes[2], votes[1])]
            out.append({"kind": k, "start": m.start(), "end": m.end(), "base": base, "votes": tuple(votes), "features": features})
    return [c for c in out if c["base"] or not any(b["base"] and b["start"] < c["end"] and c["start"] < b["end"] for b in out)]


def brute_luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute_spans(texts, rounds=25):
    """The spans of each text, as text: EM over votes, naive Bayes weighed by its posteriors, base spans always."""
    rows = [(i, c) for i, t in enumerate(texts) for c in brute_candidates(t or "")]
    kept = {}
    for kind in range(len(pii.KINDS)):
        own = [(i, c) for i, c in rows if c["kind"] == kind]
        pi, a = 0.5, [0.8] * pii.LABELERS

        def posterior(votes):
            yes, no = pi, 1 - pi  # noqa: B023
            for v, r in zip(votes, a, strict=True):  # noqa: B023
                yes, no = (yes * r, no * (1 - r)) if v == 1 else (yes * (1 - r), no * r) if v == 0 else (yes, no)
            return yes / (yes + no)

        for _ in range(rounds):
            q = [posterior(c["votes"]) for _, c in own]
            right = [8 + sum(p if c["votes"][k] == 1 else 1 - p if c["votes"][k] == 0 else 0 for p, (_, c) in zip(q, own, strict=True)) for k in range(pii.LABELERS)]
            cast = [10 + sum(c["votes"][k] >= 0 for _, c in own) for k in range(pii.LABELERS)]
            pi, a = (1 + sum(q)) / (2 + len(q)), [x / y for x, y in zip(right, cast, strict=True)]
        q = [posterior(c["votes"]) for _, c in own]
        yes, no = sum(q), sum(1 - p for p in q)
        counts = {}
        for p, (_, c) in zip(q, own, strict=True):
            for f, v in enumerate(c["features"]):
                x, y = counts.get((f, v), (0, 0))
                counts[f, v] = (x + p, y + 1 - p)
        for i, c in own:
            score = math.log((yes + 1) / (no + 1)) + sum(math.log((counts[f, v][0] + 1) / (yes + 34)) - math.log((counts[f, v][1] + 1) / (no + 34)) for f, v in enumerate(c["features"]))
            if c["base"] or score > 0:
                kept.setdefault(i, set()).add((kind, c["start"], c["end"]))
    return [",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(kept.get(i, ()))) for i in range(len(texts))]


def test_spans_against_brute_force(spark, sf_docs):
    """All spans, added ones too, over the documents and over texts on which the labelers disagree."""
    rnd = random.Random(9)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    parts = [
        lambda: f"call {digits(3)}-{digits(3)}-{digits(4)}", lambda: f"order ({digits(3)}) {digits(3)}.{digits(4)}", lambda: f"mail jo{digits(2)} [at] host{digits(1)}.com", lambda: f"image a{digits(2)}(at)file.png",
        lambda: f"token = '{digits(8)}abcdEF'", lambda: "AKIA" + digits(16), lambda: f"from {rnd.randrange(300)}.{rnd.randrange(300)}.1.{rnd.randrange(300)}", lambda: f"version 0.{digits(2)}.3.4", lambda: f"+{digits(2)} {digits(3)} {digits(4)}",
        lambda: f"card 4{digits(15)}", lambda: f"isbn {digits(13)}", lambda: f"page 555-555-{digits(4)}", lambda: "plain words here",
    ]
    texts = [d["text"] for d in sf_docs] + [" ".join(rnd.choice(parts)() for _ in range(rnd.randrange(1, 6))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.personal_data(df)).collect()}
    want = brute_spans(texts)
    assert [got[i] for i in range(len(texts))] == want
    base = [",".join(x for x in w.split(",")) for w in want]
    assert any("secret:" in w for w in base) and any("phone:" in w for w in base[len(sf_docs) :])
