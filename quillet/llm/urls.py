"""URL verdicts: listed rules first, else naive Bayes over the words of host and path.

Host labels are split into words by a unigram Viterbi search. The unigram counts come from the visible text of all pages.
No dictionary is sent around: the distinct labels' substrings of the lengths that words have are joined with the counts,
so each label arrives with just the words that it may contain. Words and labels have any length. Naive Bayes is trained on
all urls that a rule decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, join_by_hot_key, stored


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block"))


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. The list of rules is a parameter of the query."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def visible_text(html: Column) -> Column:
    """Lower-cased text outside tags, scripts and styles. Each step is linear, however many tags stay open."""
    pieces = F.split(F.lower(F.coalesce(html, F.lit(""))), r"<(?=(?:script|style)\b)")
    # a piece that starts with a script or style loses it up to its end tag, if it has one before the next
    cut = lambda x, i: F.when(i == 0, x).otherwise(F.regexp_replace(F.concat(F.lit("<"), x), r"(?s)^<(?:script.*?</script|style.*?</style)", "<"))
    return F.regexp_replace(F.array_join(F.transform(pieces, cut), " "), r"<[^<>]*+>", " ")


def unigrams(pages: DataFrame) -> DataFrame:
    """(word, n): words of two letters or more in the visible text of all pages."""
    words = pages.select(F.explode(F.split(visible_text(F.col("html")), r"[^\p{L}]+")).alias("word"))
    return words.where(F.length("word") > 1).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(label: str, words: dict[tuple[int, int], float], total: float) -> list[str]:
    """The split of label with the highest product of word probabilities; an unknown word of k letters has 10 / (total * 10^k).

    words: the known ones by (start, end). Of equal splits the one whose last word starts first, known or not.
    """
    n, ending = len(label), {}
    for (start, end), p in words.items():
        ending.setdefault(end, []).append((start, p))
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    unknown = 1 - math.log10(max(total, 10.0))
    lead, lead_at = 0.0, 0  # the best score[start] + start so far: where an unknown word of any length starts
    for end in range(1, n + 1):
        if best[end - 1] + end - 1 > lead:
            lead, lead_at = best[end - 1] + end - 1, end - 1
        best[end], back[end] = lead + unknown - end, lead_at
        for start, p in ending.get(end, ()):
            score = best[start] + p
            if score > best[end] or (score == best[end] and start < back[end]):
                best[end], back[end] = score, start
    out = []
    while n:
        out.append(label[back[n] : n])
        n = back[n]
    return out[::-1]


def segment_labels(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """labels (label), distinct -> (label, words)."""
    counts = stored(counts, "unigrams")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # k different lengths need words of k * k / 2 letters at least
    lengths = sorted(r["size"] for r in counts.select(F.length("word").alias("size")).distinct().collect())
    starts = labels.where("length(label) > 1").select("label", F.explode(F.sequence(F.lit(0), F.length("label") - 2)).alias("start"))
    fits = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda k: F.col("start") + k <= F.length("label"))
    spans = starts.select("label", "start", F.explode(fits).alias("size"))
    subs = spans.select("label", "start", (F.col("start") + F.col("size")).alias("end"), F.expr("substring(label, start + 1, size)").alias("word"))
    known = subs.join(counts, "word").groupBy("label").agg(F.collect_list(F.struct("start", "end", F.log10(F.col("n") / F.lit(float(max(total, 1)))).alias("p"))).alias("known"))
    every = labels.join(known, "label", "left")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [viterbi(x, {(k["start"], k["end"]): k["p"] for k in (ks if ks is not None else ())}, total) for x, ks in zip(pdf["label"], pdf["known"], strict=True)]
            yield pd.DataFrame({"label": pdf["label"], "words": found})

    return every.mapInPandas(split, "label string, words array<string>")


def url_verdicts(pages: DataFrame, rules: Sequence[Rule] = RULES, smoothing: float = 1.0) -> DataFrame:
    """One row per row of pages: page_id, url, host, path, rule, verdict, score (log odds of block, null where a rule decides).

    A null url, or one without ://, has an empty host and path and is judged by the prior. Without rule-decided urls of
    both verdicts the prior is even and the verdict is allow. Repeated rows get equal rows; no rows give no rows; null
    html only adds no words; columns beyond page_id, url and html are ignored.
    """
    parsed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "url", "host", "path", "r.rule", F.col("r.verdict").alias("ruled"))
    parsed = stored(parsed.withColumn("row", F.monotonically_increasing_id()), "urls")
    label = F.explode(F.array_distinct(F.split("host", r"[^\p{L}\p{N}]+")))
    labels = parsed.select("host").distinct().select(label.alias("label")).where("label != ''").distinct()
    split = stored(segment_labels(labels, unigrams(pages)), "labels")
    hosts = parsed.select("host").distinct().select("host", F.posexplode(F.split("host", r"[^\p{L}\p{N}]+")).alias("i", "label"))
    host_words = join_by_hot_key(hosts, split, "label").select("host", F.explode("words").alias("token"))
    path_words = parsed.select("row", "ruled", F.explode(F.split(F.regexp_replace(F.lower("path"), "[0-9]+", "#"), r"[^\p{L}#]+")).alias("token")).where("token != ''")
    # a token's place is part of it: the same word means different things in host and path
    per_host = stored(host_words.groupBy("host").agg(F.collect_list(F.concat(F.lit("h:"), "token")).alias("host_tokens")), "host_words")
    tokens = join_by_hot_key(parsed.select("row", "host", "ruled"), per_host, "host").select("row", "ruled", F.explode("host_tokens").alias("token"))
    tokens = tokens.unionAll(path_words.select("row", "ruled", F.concat(F.lit("p:"), "token").alias("token")))
    tokens = stored(tokens, "url_tokens")
    block, allow = F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)), F.sum(F.when(F.col("ruled") == "allow", 1).otherwise(0))
    counts = tokens.where("ruled is not null").groupBy("token").agg(block.alias("b"), allow.alias("a"))
    counts = stored(counts, "bayes")
    s = counts.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count("*").alias("v")).first()
    p = parsed.agg(block.alias("b"), allow.alias("a")).first()
    tb, ta = (s["b"] or 0) + smoothing * (s["v"] + 1), (s["a"] or 0) + smoothing * (s["v"] + 1)
    prior = math.log(((p["b"] or 0) + 1) / ((p["a"] or 0) + 1)) if p["b"] and p["a"] else 0.0
    weight = F.log((F.col("b") + smoothing) / F.lit(tb)) - F.log((F.col("a") + smoothing) / F.lit(ta))
    score = join_by_hot_key(tokens.where("ruled is null").select("row", "token"), counts.select("token", weight.alias("w")), "token").groupBy("row").agg((F.sum("w") + prior).alias("score"))
    both = parsed.join(score, "row", "left")
    nb = F.when(F.coalesce("score", F.lit(prior)) > 0, "block").otherwise("allow")
    return both.select("page_id", "url", "host", "path", "rule", F.coalesce("ruled", nb).alias("verdict"), F.when(F.col("ruled").isNull(), F.coalesce("score", F.lit(prior))).alias("score"))
