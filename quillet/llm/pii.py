"""Personal data by weak supervision. DataFrame and SQL functions only.

Candidate spans come from strict patterns (the base) and looser ones. Four labelers vote on each candidate, yes, no or
abstain: the pattern's own check, a gazetteer, context words and the variety of digits. Expectation-maximisation over
the table of vote patterns (at most 3^4 a kind, whatever the corpus) estimates each labeler's reliability, its posteriors
weigh a naive Bayes classifier over the candidates' features, and that classifier decides on candidates outside the base.
Base spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, let, stored, text_of

#: Kinds in the order of the digests. All but `secret` have a base pattern.
KINDS = ("email", "ip", "card", "phone", "secret")

#: Base patterns, written without backtracking: a run is entered at its first character (or where the last match ended)
#: and taken whole, which finds the leftmost matches in time linear in the text.
BASE = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (None, r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Looser patterns for what the base cannot see: kind, a substring they need (or none), pattern.
LOOSE = (
    ("email", None, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)++"),
    ("phone", None, r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("secret", None, r"(?:password|token|secret|api_key)\x20?[=:]\x20?[\"']?[A-Za-z0-9]{12,}+[\"']?|(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
)
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"

#: Gazetteers (yes, no) and context words (yes, no) by kind, as patterns over the span and over the text around it.
GAZETTEER = {
    "email": (r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu)$", r"(?i)\.(?:png|jpg|gif|js|css)$"),
    "ip": (None, r"^(?:0|127|255)\."),
    "card": (r"^(?:4|5[1-5]|2[2-7]|3[47]|6)", r"^[01]"),
    "phone": (r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", r"^\+0"),
    "secret": (r"^(?:AKIA|password|token|secret|api_key)", None),
}
CONTEXT = {
    "email": (r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b", r"(?i)\b(?:image|file)\b"),
    "ip": (r"(?i)\b(?:ip|address|server|host|from|login)\b", r"(?i)\b(?:version|release|section|chapter|v)\b"),
    "card": (r"(?i)\b(?:card|visa|mastercard|credit|debit|pay)\b", r"(?i)\b(?:order|invoice|isbn|serial|tracking|token)\b"),
    "phone": (r"(?i)\b(?:phone|call|tel|fax|mobile|cell)\b", r"(?i)\b(?:order|invoice|isbn|serial|page)\b"),
    "secret": (r"(?i)\b(?:key|login|password|user|access|token)\b", None),
}
CONTEXT_CHARS = 40
LABELERS = 4
START, END = "\x01", "\x02"


def _pieces(text: Column, needs: str | None, pattern: str, name: str, loose: bool) -> Column:
    """The text cut before every match: structs with the piece's length, its match and what stands around it."""
    marked = F.regexp_replace(text, f"({pattern})", f"{START}$1{END}")
    parts = F.split(marked, START)

    def piece(x: Column, i: Column) -> Column:
        tail = F.when(i == 0, x).otherwise(F.substring_index(x, END, -1))
        return F.struct(
            F.lit(KINDS.index(name)).alias("kind"),
            F.lit(loose).alias("loose"),
            i.alias("i"),
            (F.length(x) - F.when(i == 0, 0).otherwise(1)).alias("len"),
            F.when(i > 0, F.substring_index(x, END, 1)).alias("match"),
            F.right(tail, F.lit(CONTEXT_CHARS)).alias("tail"),
            F.left(tail, F.lit(CONTEXT_CHARS)).alias("head"),
        )

    present = F.lit(True) if needs is None else F.contains(text, F.lit(needs))
    if name in ("ip", "card", "phone"):
        present = present & text.rlike("[0-9]")
    if name == "secret" or (loose and name == "email"):
        present = present & text.rlike(pattern)
    none = F.slice(F.transform(F.array(F.lit("")), piece), 2, 1)
    cut = F.when(present, let(parts, lambda p: F.when(F.size(p) > 1, F.transform(p, piece))))
    return F.coalesce(cut, none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def _base_check(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    by = (F.when(kind == 0, True).when(kind == 1, match.rlike(IP_PARTS)).when(kind == 2, _luhn(digits)).when(kind == 3, F.length(digits).between(9, 15)))
    return F.coalesce(by, F.lit(False))


def _by_kind(table: dict, value: Column, kind: Column, yes: int) -> Column:
    out = F.lit(False)
    for i, name in enumerate(KINDS):
        if table[name][1 - yes]:
            out = F.when(kind == i, value.rlike(table[name][1 - yes])).otherwise(out)
    return out


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(-1)


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows: row, doc_id, text_key. spans: row, kind, start, end, base, votes and features."""
    raw = docs.select("doc_id", F.xxhash64(text_of()).alias("text_key"), text_of().alias("t")).withColumn("row", F.monotonically_increasing_id())
    # the marks must not occur in the text; no pattern looks at control characters
    marks = F.contains("t", F.lit(START)) | F.contains("t", F.lit(END))
    raw = raw.withColumn("t", F.when(marks, F.translate("t", START + END, "\x03\x03")).otherwise(F.col("t")))
    pieces = [_pieces(F.col("t"), needs, p, k, False) for k, (needs, p) in BASE.items()] + [_pieces(F.col("t"), needs, p, k, True) for k, needs, p in LOOSE]
    cut = stored(raw.select("row", "doc_id", "text_key", F.concat(*pieces).alias("pieces")), "pieces")
    each = cut.where(F.size("pieces") > 0).select("row", F.explode("pieces").alias("p")).select("row", "p.*")
    order = Window.partitionBy("row", "kind", "loose").orderBy("i")
    placed = each.withColumn("start", F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("before", F.lag("tail").over(order)).where("i > 0")
    placed = placed.withColumn("end", F.col("start") + F.length("match")).withColumn("base", ~F.col("loose") & _base_check(F.col("kind"), F.col("match")))
    around = F.concat_ws(" ", "before", "head")
    digits = _digits(F.col("match"))
    variety = F.size(F.array_distinct(F.split(digits, "")))
    kind = F.col("kind")
    votes = F.array(
        F.when(F.col("base") | (F.col("loose") & (kind != 3)), 1).when(F.col("loose"), -1).otherwise(0),
        _vote(_by_kind(GAZETTEER, F.when(kind == 2, digits).otherwise(F.col("match")), kind, 1), _by_kind(GAZETTEER, F.when(kind == 2, digits).otherwise(F.col("match")), kind, 0)),
        _vote(_by_kind(CONTEXT, around, kind, 1), _by_kind(CONTEXT, around, kind, 0)),
        F.when(kind.isin(0, 4), -1).when(variety >= 4, 1).when(variety <= 2, 0).otherwise(-1),
    )
    features = F.array(
        F.least(F.length("match"), F.lit(48)) / 3,
        F.least(F.length(digits), F.lit(20)),
        F.length("match") - F.length(F.translate("match", " -().@", "")),
        votes[2],
        votes[1],
    )
    spans = placed.select("row", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "base", votes.alias("votes"), F.transform(features, lambda x: F.least(F.floor(x), F.lit(32)).cast("int")).alias("features"))
    # a candidate that overlaps a base span of its document has nothing to add
    seen = Window.partitionBy("row").orderBy("start", "end")
    last = F.max(F.when(F.col("base"), F.col("end"))).over(seen.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.min(F.when(F.col("base"), F.col("start"))).over(seen.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    clear = F.coalesce(last <= F.col("start"), F.lit(True)) & F.coalesce(following >= F.col("end"), F.lit(True))
    free = spans.withColumn("clear", clear).where(F.col("base") | F.col("clear")).drop("clear")
    return cut.select("row", "doc_id", "text_key"), stored(free, "spans")


#: One EM run on a kind's vote table ps: array<struct<v array<int>, n double>>. The reliabilities have a prior of 8 right and 2 wrong.
_EM = """
aggregate(sequence(1, {rounds}), named_struct('pi', 0.5D, 'a', array_repeat(0.8D, {k})), (s, i) ->
  aggregate(array(transform(ps, p -> named_struct('n', p.n, 'v', p.v, 'yes',
      aggregate(sequence(0, {k} - 1), s.pi, (t, l) -> t * CASE p.v[l] WHEN 1 THEN s.a[l] WHEN 0 THEN 1D - s.a[l] ELSE 1D END), 'no',
      aggregate(sequence(0, {k} - 1), 1D - s.pi, (t, l) -> t * CASE p.v[l] WHEN 1 THEN 1D - s.a[l] WHEN 0 THEN s.a[l] ELSE 1D END)))), s, (z, qs) ->
    named_struct('pi', (1D + aggregate(qs, 0D, (t, q) -> t + q.n * q.yes / (q.yes + q.no))) / (2D + aggregate(qs, 0D, (t, q) -> t + q.n)),
      'a', transform(sequence(0, {k} - 1), l ->
        (8D + aggregate(qs, 0D, (t, q) -> t + q.n * CASE q.v[l] WHEN 1 THEN q.yes / (q.yes + q.no) WHEN 0 THEN q.no / (q.yes + q.no) ELSE 0D END))
        / (10D + aggregate(qs, 0D, (t, q) -> t + CASE WHEN q.v[l] >= 0 THEN q.n ELSE 0D END))))))
"""


def reliabilities(spans: DataFrame, rounds: int = 25) -> DataFrame:
    """(kind, pi, a): share of true candidates and each labeler's reliability, by EM over the vote patterns."""
    table = spans.groupBy("kind", F.col("votes").alias("v")).agg(F.count("*").cast("double").alias("n"))
    rows = table.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("ps"))
    return rows.select("kind", F.expr(_EM.format(rounds=rounds, k=LABELERS)).alias("m")).select("kind", "m.pi", "m.a")


def _posterior(pi: Column, a: Column, votes: Column) -> Column:
    yes, no = pi, 1 - pi
    for i in range(LABELERS):
        v, r = votes[i], a[i]
        yes = yes * F.when(v == 1, r).when(v == 0, 1 - r).otherwise(1.0)
        no = no * F.when(v == 1, 1 - r).when(v == 0, r).otherwise(1.0)
    return yes / (yes + no)


def classify(spans: DataFrame, rounds: int = 25) -> DataFrame:
    """spans with score: the log odds of a naive Bayes classifier that was trained on the EM posteriors."""
    model = stored(reliabilities(spans, rounds), "reliabilities")
    q = spans.join(model, "kind").select("row", "kind", "start", "end", "base", "features", _posterior(F.col("pi"), F.col("a"), F.col("votes")).alias("q"))
    q = stored(q, "posteriors")
    values = q.select("kind", "q", F.posexplode("features").alias("f", "value"))
    # at most 5 features of 34 values a kind
    counts = values.groupBy("kind", "f", "value").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no"))
    totals = q.groupBy("kind").agg(F.sum("q").alias("all_yes"), F.sum(1 - F.col("q")).alias("all_no"))
    weights = counts.join(totals, "kind").select("kind", "f", "value", (F.log((F.col("yes") + 1) / (F.col("all_yes") + 34)) - F.log((F.col("no") + 1) / (F.col("all_no") + 34))).alias("w"))
    weights = stored(weights, "weights")
    prior = totals.select("kind", F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1)).alias("prior"))
    key = ["row", "kind", "start", "end", "base"]
    scored = q.select(*key, F.posexplode("features").alias("f", "value")).join(weights, ["kind", "f", "value"]).groupBy(*key).agg(F.sum("w").alias("w"))
    return scored.join(stored(prior, "priors"), "kind").select(*key, (F.col("w") + F.col("prior")).alias("score"))


def personal_data(docs: DataFrame, rounds: int = 25) -> DataFrame:
    """One row per row of docs: doc_id, text_key, spans: array<struct<kind, start, end, base>> in the order of KINDS and start.

    Offsets are code points, end exclusive. Null and empty texts have no spans; repeated rows get equal rows; no rows give
    no rows; columns beyond doc_id and text are ignored. Texts of any length are matched whole.
    """
    rows, spans = candidates(docs)
    found = classify(spans, rounds).where(F.col("base") | (F.col("score") > 0))
    # of equal spans, which strict and loose patterns may both give, one stays
    once = found.groupBy("row", "kind", "start", "end").agg(F.max("base").alias("base"))
    lists = once.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", "base"))).alias("spans"))
    return rows.join(lists, "row", "left").select("doc_id", "text_key", F.coalesce("spans", F.array().cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean>>")).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, text_key, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans of personal_data()."""
    base = F.filter("spans", lambda s: s["base"])
    of_kind = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(of_kind) - F.size(F.array_remove(of_kind, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select("doc_id", "text_key", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rounds: int = 25) -> DataFrame:
    """docs with a column clean_text in which every found span is replaced by its kind in angle brackets.

    Each piece of text between spans is cut out once; of overlapping spans the first stays. A null text becomes the empty one,
    texts of any length are redacted whole, repeated rows get equal texts, a column of that name in docs is replaced, all
    others stay, and no rows give no rows.
    """
    docs = docs.drop("clean_text")
    found = personal_data(docs, rounds).dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_text"), "spans")
    key = free_name(docs, "k_hash")
    both = docs.withColumn(key, F.xxhash64(text_of())).alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.k_id")) & (F.col(f"d.{key}") == F.col("f.k_text")))
    text = F.coalesce(F.col("d.text"), F.lit(""))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    ordered = F.sort_array(F.transform("f.spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    cut = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(F.concat(a["out"], cut(a["at"], s["start"]), F.get(names, s["kind"])).alias("out"), s["end"].alias("at")))
    clean = F.aggregate(ordered, zero, step, lambda a: F.concat(a["out"], cut(a["at"], F.length(text).cast("long"))))
    return both.select("d.*", clean.alias("clean_text")).drop(key)
