"""Language-model scoring with a probabilistic suffix tree (Ron, Singer and Tishby 1996) over bytes.

A text is its lower-cased words, joined by single spaces and closed by a line feed, as UTF-8 bytes. All windows of
`depth` + 1 bytes of all training documents are counted. A context of up to `depth` bytes is a candidate if it stands
`min_count` times, an absolute number, so candidates grow with the corpus; it is retained, with its suffixes, if its
next-byte distribution diverges from its suffix's by more than `divergence` nats times its count. Contexts of one byte
are few and retained whenever they are candidates. Distributions are smoothed towards the suffix's. A byte is scored in
the state of the longest retained suffix before it.

The tree has no size limit and is never in one place. It is built in slices by the last two bytes of a context, which
hold every context of two bytes or more together with its suffixes; one-byte contexts and the root are a table of 256 by
256. Slices are files in the shared folder. Scoring takes as many slices at a time as `pass_entries` allows, one pass
over the documents for each such part, and adds up: a byte belongs to the slice of the two bytes before it.

The unigram base needs the count of every token. Tokens of at most `common_bytes` bytes with a share of at least `common`
of all, which are at most 1 / common, are looked up in the workers; all others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, text_of

END = 0x0A
CHUNK = 1 << 20
FLUSH_TOKENS, FLUSH_GRAMS = 300_000, 1_500_000
CLASSES = 1 << 16


@dataclass(frozen=True)
class TreeLimits:
    depth: int = 5  # bytes of the longest context, 2 to 6
    min_count: int = 16
    divergence: float = 8.0
    smoothing: float = 4.0
    common: float = 1e-6
    common_bytes: int = 64
    #: Windows that a task builds a slice from, and entries of the tree that a worker holds: memory, not results.
    build_rows: int = 4_000_000
    pass_entries: int = 8_000_000


def held_out(doc_id: Column, remainder: int) -> Column:
    """crc32 of the id as text, modulo 5; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == remainder


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def packed(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): every text after `depth` end symbols and with one behind; starts: its first byte's place."""
    lead = bytes([END]) * depth
    flat = np.frombuffer(b"".join(lead + t + lead[:1] for t in texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64) + depth + 1
    return flat, np.concatenate(([0], np.cumsum(sizes)[:-1])) + depth


def windows(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows of depth + 1 bytes, first byte highest, one at each byte; True where the byte is a text's; starts)."""
    flat, starts = packed(texts, depth)
    code = np.zeros(len(flat), np.int64)
    for back in range(depth + 1):
        code[back:] |= flat[: len(flat) - back].astype(np.int64) << (8 * back)
    mask = np.ones(len(flat), bool)
    for back in range(1, depth + 1):
        mask[starts - back] = False
    return code, mask, starts


def window_counts(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, count) of the windows that end at a text's bytes."""
    code, mask, _ = windows(texts, depth)
    return np.unique(code[mask], return_counts=True)


def _chunks(texts: Iterator[str | None]) -> Iterator[list[list[bytes]]]:
    out, size = [], 0
    for t in texts:
        out.append(words(t or ""))
        size += len(t or "")
        if size >= CHUNK:
            yield out
            out, size = [], 0
    if out:
        yield out


def corpus_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(token, gram, n): partial counts of tokens (empty: the end) and of byte windows over all of docs, stored."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, grams, held = Counter(), [], 0

        def flush_grams() -> pd.DataFrame:
            keys, inverse = np.unique(np.concatenate([g for g, _ in grams]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([c for _, c in grams])).astype(np.int64)
            grams.clear()
            return pd.DataFrame({"token": None, "gram": pd.array(keys, "Int64"), "n": n})

        def flush_tokens() -> pd.DataFrame:
            out = pd.DataFrame({"token": [t.decode("utf-8", "surrogatepass") for t in tokens], "gram": pd.array([None] * len(tokens), "Int64"), "n": list(tokens.values())})
            tokens.clear()
            return out

        for pdf in batches:
            for chunk in _chunks(iter(pdf["text"])):
                for w in chunk:
                    tokens.update(w)
                tokens[b""] += len(chunk)
                grams.append(window_counts([b" ".join(w) for w in chunk], depth))
                held += len(grams[-1][0])
                if held > FLUSH_GRAMS:
                    yield flush_grams()
                    held = 0
                if len(tokens) > FLUSH_TOKENS:
                    yield flush_tokens()
        if grams:
            yield flush_grams()
        if tokens:
            yield flush_tokens()

    return stored(docs.select("text").mapInPandas(count, "token string, gram long, n long"), "counts")


def _mask(n_bytes: int) -> int:
    return (1 << 8 * n_bytes) - 1


def short_logs(pairs: np.ndarray, limits: TreeLimits) -> np.ndarray:
    """log10 p of a byte after one byte, 256 by 256, from the counts of pairs. Unseen bytes share the root's smoothing."""
    root = pairs.sum(0)
    p0 = (root + 1.0) / (root.sum() + 256.0)
    total = pairs.sum(1, keepdims=True)
    p1 = (pairs + limits.smoothing * p0) / (total + limits.smoothing)
    return np.log10(np.where(total >= limits.min_count, p1, p0))


def build_slice(gram: np.ndarray, n: np.ndarray, pairs: np.ndarray, limits: TreeLimits) -> pd.DataFrame:
    """(depth, state, key, value) of the retained contexts of two bytes or more, from all windows whose context ends in certain two bytes.

    state 0: key is context and byte, value log10 p. state 1: key is the context, value log10 of what an unseen byte's
    probability after the shorter context is multiplied by.
    """
    short, tau = 10 ** short_logs(pairs, limits), limits.smoothing
    level = {}
    for d in range(2, limits.depth + 1):
        key, inverse = np.unique(gram & _mask(d + 1), return_inverse=True)
        c = np.bincount(inverse, n)
        starts = np.flatnonzero(np.concatenate(([True], key[1:] >> 8 != key[:-1] >> 8)))
        total = np.add.reduceat(c, starts)
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
        level[d] = {"key": key, "n": c, "ctx": key[starts] >> 8, "starts": starts, "all": total, "of": of}
        if d == 2:
            up_n, up_all = pairs[key >> 8 & 255, key & 255], pairs.sum(1)[key >> 8 & 255]
        else:
            at = np.searchsorted(level[d - 1]["key"], key & _mask(d))
            level[d]["up"] = at
            up_n, up_all = level[d - 1]["n"][at], level[d - 1]["all"][level[d - 1]["of"][at]]
        gain = np.add.reduceat(c * np.log((c / total[of]) / (up_n / up_all)), starts)
        level[d]["kept"] = (gain > limits.divergence) & (total >= limits.min_count)
    out = []
    for d in range(limits.depth, 2, -1):
        ctx, below = level[d]["ctx"][level[d]["kept"]] & _mask(d - 1), level[d - 1]
        below["kept"][np.searchsorted(below["ctx"], ctx)] = True
    for d, x in level.items():
        lower = short[x["key"] >> 8 & 255, x["key"] & 255] if d == 2 else level[d - 1]["p"][x["up"]]
        x["p"] = (x["n"] + tau * lower) / (x["all"][x["of"]] + tau)
        kept = x["kept"][x["of"]]
        out.append(pd.DataFrame({"depth": d, "state": 0, "key": x["key"][kept], "value": np.log10(x["p"][kept])}))
        out.append(pd.DataFrame({"depth": d, "state": 1, "key": x["ctx"][x["kept"]], "value": np.log10(tau / (x["all"][x["kept"]] + tau))}))
    return pd.concat(out)


def _packed_up(sizes: np.ndarray, most: int) -> np.ndarray:
    """A number for each size, rising, so that those of one number sum to no more than most, or are one alone."""
    out, at, have = np.zeros(len(sizes), np.int32), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if have and have + n > most:
            at, have = at + 1, 0
        out[i], have = at, have + n
    return out


@dataclass(frozen=True)
class Tree:
    """Where the tree's slices lie, and what is small: the table of one-byte contexts, each class's slice, the slices of each pass."""

    path: str
    short: np.ndarray
    slice_of: np.ndarray
    passes: tuple[tuple[int, ...], ...]


def build_tree(counts: DataFrame, limits: TreeLimits = TreeLimits()) -> Tree:
    """The tree of corpus_counts(). Classes are the two bytes before a byte: at most 65,536, which the driver may hold."""
    if not 2 <= limits.depth <= 6:
        raise ValueError("contexts have 2 to 6 bytes at most")
    grams = stored(counts.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    short = grams.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("pair")).agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros(CLASSES)
    pairs[short["pair"].to_numpy(np.int64)] = short["n"]
    pairs = pairs.reshape(256, 256)
    of = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("class")
    found = grams.groupBy(of).agg(F.count("*").alias("n")).toPandas()
    sizes = np.zeros(CLASSES, np.int64)
    sizes[found["class"].to_numpy(np.int64)] = found["n"]
    slice_of = _packed_up(sizes, limits.build_rows)
    names = grams.sparkSession.createDataFrame(pd.DataFrame({"class": found["class"], "slice": slice_of[found["class"].to_numpy(np.int64)]}), "class int, slice int")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return build_slice(pdf["gram"].to_numpy(), pdf["n"].to_numpy(np.float64), pairs, limits).assign(slice=pdf["slice"].iloc[0])

    sliced = grams.select("gram", "n", of).join(F.broadcast(names), "class").select("slice", "gram", "n")
    tree = stored(sliced.groupBy("slice").applyInPandas(build, "slice int, depth int, state int, key long, value double"), "tree")
    entries = tree.groupBy("slice").agg(F.count("*").alias("n")).orderBy("slice").toPandas()  # at most one row a class
    held = np.zeros(int(slice_of[-1]) + 1, np.int64)
    held[entries["slice"].to_numpy(np.int64)] = entries["n"]
    part = _packed_up(held, limits.pass_entries)
    discard(grams)
    return Tree(tree.stored_at, short_logs(pairs, limits), slice_of, tuple(tuple(np.flatnonzero(part == i).tolist()) for i in range(int(part[-1]) + 1)))


class SuffixTree:
    """Part of a tree in memory: sorted keys and values of each depth. Bytes of other slices score 0."""

    def __init__(self, table: pd.DataFrame, short: np.ndarray, mine: np.ndarray, depth: int) -> None:
        self.short, self.mine, self.depth, self.levels = short.ravel(), mine, depth, {}
        for d in range(2, depth + 1):
            for state in (0, 1):
                t = table[(table["depth"] == d) & (table["state"] == state)]
                order = np.argsort(t["key"].to_numpy())
                self.levels[d, state] = t["key"].to_numpy()[order], t["value"].to_numpy()[order].astype(np.float32)

    @staticmethod
    def _find(level: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(True where a key is there, values of those)."""
        if not len(level[0]):
            return np.zeros(len(keys), bool), np.zeros(0)
        at = np.minimum(np.searchsorted(level[0], keys), len(level[0]) - 1)
        hit = level[0][at] == keys
        return hit, level[1][at[hit]]

    def logs(self, code: np.ndarray) -> np.ndarray:
        """log10 p of the last byte of each window after the others."""
        out = np.zeros(len(code))
        left = np.flatnonzero(self.mine[code >> 8 & 0xFFFF])
        for d in range(self.depth, 1, -1):
            w = code[left]
            hit, value = self._find(self.levels[d, 0], w & _mask(d + 1))
            out[left[hit]] += value
            left, w = left[~hit], w[~hit]
            known, value = self._find(self.levels[d, 1], w >> 8 & _mask(d))
            out[left[known]] += value
        out[left] += self.short[code[left] & 0xFFFF]
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text with its end symbol, as far as its bytes are in this part."""
        if not texts:
            return np.zeros(0)
        code, mask, starts = windows(texts, self.depth)
        distinct, inverse = np.unique(code[mask], return_inverse=True)
        each = np.zeros(len(code))
        each[mask] = self.logs(distinct)[inverse]
        return np.add.reduceat(each, starts - self.depth)


_parts: dict[tuple, SuffixTree] = {}


def part_of(tree: Tree, number: int, depth: int) -> SuffixTree:
    """A pass's part of the tree, read from the shared folder. A worker holds one at a time."""
    if (tree.path, number) not in _parts:
        import pyarrow.parquet as pq
        from pyarrow import fs

        _parts.clear()
        system, path = fs.FileSystem.from_uri(tree.path)
        chosen = list(tree.passes[number])
        table = pq.read_table(path, columns=["depth", "state", "key", "value"], filters=[("slice", "in", chosen)], filesystem=system).to_pandas()
        _parts[tree.path, number] = SuffixTree(table, tree.short, np.isin(tree.slice_of, chosen), depth)
    return _parts[tree.path, number]


def score_documents(docs: DataFrame, remainder: int = 1, limits: TreeLimits = TreeLimits()) -> DataFrame:
    """One row per row of docs: doc_id, text_key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training takes all documents that are not held out. Null and empty texts hold the end token only; repeated rows count
    as often as they stand; without training documents no token is known and every byte is equally likely; no rows give no
    rows; columns beyond doc_id and text are ignored.
    """
    spark = docs.sparkSession
    counts = corpus_counts(docs.where(~held_out(F.col("doc_id"), remainder)), limits.depth)
    tokens = stored(counts.where("token is not null").groupBy("token").agg(F.sum("n").alias("c")), "tokens")
    facts = tokens.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, bottom = facts["n"] or 0, (facts["n"] or 0) + 0.5 * (facts["v"] + 1)
    often = (F.col("c") >= F.lit(max(1.0, limits.common * total))) & (F.octet_length("token") <= limits.common_bytes)
    known = {r["token"].encode("utf-8", "surrogatepass"): float(np.log10((r["c"] + 0.5) / bottom)) for r in tokens.where(often).toLocalIterator()}
    tree = build_tree(counts, limits)
    shared = spark.sparkContext.broadcast((tree, known))

    def scorer(number: int):
        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree, logs = shared.value
            part = part_of(tree, number, limits.depth)
            for pdf in batches:
                at = 0
                for chunk in _chunks(iter(pdf["text"])):
                    rows = pdf.iloc[at : at + len(chunk)]
                    at += len(chunk)
                    scores = part.score([b" ".join(w) for w in chunk])
                    facts = _token_facts(rows["row"], chunk, logs) if number == 0 else None
                    base, n_known, n_tokens = facts[0] if facts else (0.0, 0, 0)
                    yield pd.DataFrame({"row": rows["row"], "token": None, "doc_id": rows["doc_id"].astype("Int64"), "text_key": rows["text_key"], "n_tokens": n_tokens, "n_known": n_known, "base": base, "score": scores})
                    if facts:
                        yield facts[1]

        return score

    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("text_key"), text_of().alias("text")).withColumn("row", F.monotonically_increasing_id())
    if len(tree.passes) > 1:
        rows = stored(rows, "texts")  # all passes see the same numbers
    schema = "row long, token string, doc_id long, text_key long, n_tokens long, n_known long, base double, score double"
    out = stored(reduce(DataFrame.unionAll, (rows.mapInPandas(scorer(i), schema) for i in range(len(tree.passes)))), "scores")
    # the other tokens: one row for each document and token, joined with all counts
    joined = out.where("token is not null").select("row", "token", F.col("n_tokens").alias("m")).join(tokens, "token", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(bottom))
    more = joined.groupBy("row").agg(F.sum(F.col("m") * log).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("more_known"))
    each = out.where("token is null").drop("token")
    if len(tree.passes) > 1:
        each = each.groupBy("row", "doc_id", "text_key").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    each = each.join(more, "row", "left")
    return each.select(
        "doc_id",
        "text_key",
        held_out(F.col("doc_id"), remainder).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )


def _token_facts(rows: Sequence[int], chunk: list[list[bytes]], logs: dict[bytes, float]) -> tuple[tuple, pd.DataFrame]:
    """((base, n_known, n_tokens) of texts as lists, rows of the tokens that logs lacks, with their number as n_tokens)."""
    base, n_known, sizes, rare_rows, rare, times = [], [], [], [], [], []
    for row, w in zip(rows, chunk, strict=True):
        w = [*w, b""]
        found = [x for x in map(logs.get, w) if x is not None]
        base.append(float(np.sum(found)))
        n_known.append(len(found))
        sizes.append(len(w))
        if len(found) < len(w):
            other = Counter(x for x in w if x not in logs)
            rare += [x.decode("utf-8", "surrogatepass") for x in other]
            times += other.values()
            rare_rows += [row] * len(other)
    table = pd.DataFrame({"row": pd.Series(rare_rows, dtype="int64"), "token": pd.Series(rare, dtype=object), "doc_id": pd.array([None] * len(rare), "Int64"), "text_key": 0, "n_tokens": pd.Series(times, dtype="int64"), "n_known": 0, "base": 0.0, "score": 0.0})
    return (base, n_known, sizes), table
