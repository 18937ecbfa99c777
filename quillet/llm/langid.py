"""Language identification with interpolated Kneser-Ney character models, one a language.

Texts are lower-cased runs of letters joined by single spaces. The models (Kneser and Ney 1995, interpolated form of
Chen and Goodman 1999) are trained on a bounded sample: about `train_docs` whole documents of each language, chosen by a
hash of their texts from all labelled training rows. N-grams of all languages stand in one sorted array of 64-bit hashes
an order, with a row of log probabilities, one for each language. A document's language is the one with the lowest
cross-entropy a character.

Rejection is calibrated on documents that the models were not fitted on: another part of the training rows, about
`train_docs` / 4 a language. A prediction is rejected if its entropy is further above the language's mean over those than
`reject` standard deviations; the same distance lowers its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, text_of
from .pst import held_out

ORDER = 4
CHUNK = 1 << 19
LETTERS = re.compile(r"[^\W\d_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    found = " ".join(LETTERS.findall((text or "").lower()))
    return found if any(map(str.isalpha, found)) else ""  # the pattern also takes numerals that are no decimal digits


def gram_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For orders 1 to ORDER, the hash of the characters that end at each place (from ORDER - 1 on)."""
    wide, out, h = codes.astype(np.uint64) + np.uint64(1), [], None
    for n in range(ORDER):
        part = wide[ORDER - 1 - n : len(wide) - n] * (MIX ** np.uint64(2 * n + 1))
        part ^= part >> np.uint64(29)
        h = part if h is None else h * np.uint64(0xBF58476D1CE4E5B9) + part
        out.append(h ^ (h >> np.uint64(32)))
    return out


def hash_of(gram: str) -> int:
    codes = np.frombuffer(("\0" * ORDER + gram).encode("utf-32-le", "surrogatepass"), np.uint32)
    return int(gram_hashes(codes)[len(gram) - 1][-1])


class KneserNey:
    """counts: for each language, of n-grams of ORDER characters."""

    def __init__(self, langs: list[str], counts: dict[str, dict[str, int]]) -> None:
        self.langs = langs
        probs = [defaultdict(lambda: [None] * len(langs)) for _ in range(ORDER)]
        backs = [defaultdict(lambda: [0.0] * len(langs)) for _ in range(ORDER)]
        models = []
        for lang in langs:
            orders = [Counter() for _ in range(ORDER)]
            orders[-1].update(counts[lang])
            for n in range(ORDER - 1, 0, -1):  # below the top: how many characters continue a gram to the left
                orders[n - 1].update(g[1:] for g in orders[n])
            models.append(orders)
        alphabet = {g for m in models for g in m[0]}
        uniform = 1.0 / (len(alphabet) + 1)
        self.unknown = math.log10(uniform)
        for at, orders in enumerate(models):
            lower = {"": uniform}
            for n, grams in enumerate(orders):
                once, twice = sum(c == 1 for c in grams.values()), sum(c == 2 for c in grams.values())
                d = once / (once + 2 * twice) if once else 0.5
                total, kinds = Counter(), Counter()
                for g, c in grams.items():
                    total[g[:-1]] += c
                    kinds[g[:-1]] += 1
                back = {h: d * kinds[h] / total[h] for h in total}
                p = {g: max(c - d, 0) / total[g[:-1]] + back[g[:-1]] * lower[g[1:] if n else ""] for g, c in grams.items()}
                for g, x in p.items():
                    probs[n][g][at] = math.log10(x)
                for h, b in back.items():
                    backs[n][h][at] = math.log10(b)
                lower = p
        # what a language has not seen, for grams that another has: its back-off to the order below
        for n in range(ORDER):
            for g, row in probs[n].items():
                for at, x in enumerate(row):
                    if x is None:
                        below = probs[n - 1][g[1:]][at] if n else self.unknown
                        row[at] = backs[n].get(g[:-1], [0.0] * len(langs))[at] + below
        self.tables = [self._sorted(t) for t in probs]
        self.backs = [self._sorted(t) for t in backs[1:]]
        self.back_one = np.array(backs[0].get("", [0.0] * len(langs)))

    def _sorted(self, table: dict[str, list[float]]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array([hash_of(g) for g in table], np.uint64)
        order = np.argsort(keys)
        rows = np.array(list(table.values()), np.float64).reshape(len(table), len(self.langs))
        return keys[order], rows[order]

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table[0]):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return at, table[0][at] == keys

    def log_probs(self, hashes: list[np.ndarray], ctx: list[np.ndarray]) -> np.ndarray:
        """Rows of log10 p, one column a language. hashes[n - 1], ctx[n - 1]: of the n characters up to, and before, a place."""
        out = np.zeros((len(hashes[0]), len(self.langs)))
        left = np.arange(len(out))
        for n in range(ORDER, 0, -1):
            at, hit = self._find(self.tables[n - 1], hashes[n - 1][left])
            out[left[hit]] += self.tables[n - 1][1][at[hit]]
            left = left[~hit]
            if not len(left):
                break
            if n > 1:
                at, seen = self._find(self.backs[n - 2], ctx[n - 2][left])
                out[left[seen]] += self.backs[n - 2][1][at[seen]]
            else:
                out[left] += self.back_one + self.unknown
        return out

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Per text and language: -log10 p a character, over its characters and the space behind. About CHUNK characters at a time."""
        out, at = [np.zeros((0, len(self.langs)))], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and size < CHUNK:
                size += len(texts[to]) + 1
                to += 1
            out.append(self._entropies(texts[at:to]))
            at = to
        return np.concatenate(out)

    def _entropies(self, texts: list[str]) -> np.ndarray:
        lead = "\0" + " " * (ORDER - 1)
        codes = np.frombuffer("".join(lead + t + " " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64) + ORDER + 1
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        h = gram_hashes(np.concatenate((np.zeros(ORDER - 1, np.uint32), codes)))
        ctx = [np.concatenate(([np.uint64(0)], x[:-1])) for x in h]
        mask = np.ones(len(codes), bool)
        for k in range(ORDER):
            mask[starts + k] = False
        logs = np.zeros((len(codes), len(self.langs)))
        logs[mask] = self.log_probs([x[mask] for x in h], [x[mask] for x in ctx])
        return -np.add.reduceat(logs, starts, axis=0) / (sizes - ORDER)[:, None]


def train(docs: DataFrame, remainder: int = 0, train_docs: int = 1500) -> KneserNey:
    """Models of all languages of the training rows (labelled, with a letter, and not held out), with mean and spread.

    A language with too few documents for a part of its own is calibrated on those of the fit. The text with the least hash of
    a language is always in the fit, so that a language with one distinct text is learned too.
    """
    rows = docs.where(~held_out(F.col("doc_id"), remainder) & F.col("lang").isNotNull() & text_of().rlike(r"\p{L}")).select("lang", "text")
    # a row a language, as many as there are models; stored, so that Spark sees how small it is and leaves the texts in place
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("rows"), F.min(place).alias("least")), "sizes")
    share = F.least(F.lit(float(train_docs)) / F.col("rows"), F.lit(0.8))
    chosen = rows.join(sizes, "lang").withColumn("place", place).withColumn("share", share).where((F.col("place") < F.col("share") * 1.25) | (F.col("place") == F.col("least")))
    fit = (F.col("place") < F.col("share")) | (F.col("place") == F.col("least"))
    sample = stored(chosen.select("lang", "text", fit.alias("fit")), "sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = defaultdict(Counter)
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                t = "\0" + " " * (ORDER - 1) + normal(text) + " "
                found[lang].update(t[i - ORDER : i] for i in range(ORDER + 1, len(t) + 1))
        for lang, c in found.items():
            yield pd.DataFrame({"lang": lang, "gram": list(c), "n": list(c.values())})

    table = sample.where("fit").select("lang", "text").mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = {lang: dict(zip(t["gram"], t["n"].tolist(), strict=True)) for lang, t in table.groupby("lang")}
    model = KneserNey(sorted(counts), counts)
    model.mean, model.spread = {}, {}
    if counts:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf = pdf[pdf["lang"].isin(shared.value.langs)]
                h = shared.value.entropies([normal(t) for t in pdf["text"]])
                yield pd.DataFrame({"lang": pdf["lang"], "fit": pdf["fit"], "h": h[np.arange(len(h)), [shared.value.langs.index(x) for x in pdf["lang"]]]})

        found = sample.mapInPandas(measure, "lang string, fit boolean, h double").groupBy("lang", "fit").agg(F.avg("h").alias("m"), F.coalesce(F.stddev_samp("h"), F.lit(0.0)).alias("s"), F.count("*").alias("n"))
        for r in sorted(found.collect(), key=lambda r: not r["fit"]):  # outside the fit last, where there are enough
            if r["fit"] or r["n"] >= 10:
                model.mean[r["lang"]], model.spread[r["lang"]] = r["m"], max(r["s"], 0.02)
    discard(sample, sizes)
    return model


def identify(docs: DataFrame, remainder: int = 0, train_docs: int = 1500, reject: float = 4.0) -> DataFrame:
    """One row per row of docs: doc_id, text_key, held_out, lang_pred, score, entropy, rejected.

    lang, source and doc_id of a row take no part in its prediction. A null text, one without letters, and every text where
    nothing could be learned is `und` with score 0. Repeated rows get equal rows; no rows give no rows; other columns are
    ignored.
    """
    model = train(docs, remainder, train_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            texts = [normal(t) for t in pdf["text"]]
            langs, scores, best, far = [], [], [], []
            h = m.entropies(texts) if m.langs else np.zeros((len(texts), 0))
            for t, row in zip(texts, h, strict=True):
                if not t or not m.langs:
                    langs.append("und")
                    scores.append(0.0)
                    best.append(None)
                    far.append(True)
                    continue
                i = int(row.argmin())
                odds = np.exp(-(row - row[i]) * math.log(10) * min(len(t), 100))
                z = (row[i] - m.mean[m.langs[i]]) / m.spread[m.langs[i]]
                langs.append(m.langs[i])
                scores.append(float(1 / odds.sum() / (1 + math.exp(min(50.0, z - reject)))))
                best.append(float(row[i]))
                far.append(bool(z > reject))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text_key": pdf["text_key"], "lang_pred": langs, "score": scores, "entropy": pd.Series(best, dtype="Float64"), "rejected": far})

    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("text_key"), "text")
    found = rows.mapInPandas(predict, "doc_id long, text_key long, lang_pred string, score double, entropy double, rejected boolean")
    return found.select("doc_id", "text_key", held_out(F.col("doc_id"), remainder).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
