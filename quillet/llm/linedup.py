"""Line dedup by pairwise alignment.

The lines that are compared are runs of `line` words chosen by content: of every window of `passage` words the run with the
least hash. Equal passages therefore hold equal lines wherever their text breaks lines, and every passage of `passage`
words holds one. A line is rare if at most `RARE` sections of different documents hold it. Documents that share a rare line
are paired, each later one with every earlier one. Both sides of a pair are cut into units at places that their words
choose, the units are aligned by patience diff, aligned runs are extended to whole common blocks word by word, and blocks
of `passage` words or more are deleted from the later document. What the one-way order of the alignment leaves over (moved
and repeated blocks of the same pair) is compared by windows of `passage` words.

Lines that more documents hold are not paired. All windows around them are looked up instead, exactly: each window that an
earlier document holds is deleted. Documents with the same words are copies: all but the first go as a whole, and only the
first takes part. So no passage of `passage` words stays in any document but the first that holds it, and no group of
documents is ever expanded into all its pairs. Words and windows are compared by 32 and 64-bit hashes.

Whole text lines are compared too, of any length from `whole_lines` words on: a line, its white space evened out, stays in the
first document that holds it and goes from all later ones, by one grouped minimum of a line's documents. However many
documents hold a line, each is compared with that minimum alone.

Long documents are taken in sections that overlap by more than a passage, so that the work on a pair is bounded.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import discard, free_name, stored, text_of

#: Words of the shortest passage that is always found, and of a line.
PASSAGE, LINE = 50, 25
#: Documents that may hold a rare line; words of a section; words from which a unit's border is chosen.
RARE, SECTION, BORDER = 4, 2048, 12
#: Bits of the filter that spares sections without a candidate a second look (wrong hits only cost time), and what makes
#: a section's number part of its key there.
FILTER_BITS, SPREAD = 26, 2654435761
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NO_ID = (1 << 63) - 1
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def longest_increasing(values: Sequence[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience piles."""
    tops, piles, back = [], [], []
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[at], piles[at] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience_matches(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Aligned (i, j) with a[i] == b[j], increasing in both: items that are unique on both sides anchor, gaps follow suit."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {a[i]: i for i in range(a0, a1) if na[a[i]] == 1}
        both = [(at[b[j]], j) for j in range(b0, b1) if nb[b[j]] == 1 and b[j] in at]
        anchors = [both[k] for k in longest_increasing([i for i, _ in both])]
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class _Powers:
    """BASE ** i and its inverse modulo 2 ** 64, as far as they were asked for."""

    up = down = np.ones(0, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * CHUNK)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                values = np.full(size, base, np.uint64)
                values[0] = 1
                setattr(cls, name, np.cumprod(values, dtype=np.uint64))
        return cls.up, cls.down


def _spans_hashed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each start and end: polynomials modulo 2 ** 64, then mixed."""
    up, down = _Powers.to(len(values) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))
    h = (sums[ends] - sums[starts]) * down[starts]
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def word_hashes(texts: Iterator[str | None]) -> Iterator[np.ndarray]:
    """The 32-bit hashes of each text's words, each in an unsigned 64-bit integer and never 0."""

    def hashed(encoded: list[bytes]) -> Iterator[np.ndarray]:
        flat = np.frombuffer(b"\n".join(encoded), np.uint8)
        edges = np.flatnonzero(np.diff(IS_SPACE[flat].astype(np.int8), prepend=1, append=1))
        starts, ends = edges[::2], edges[1::2]
        h = _spans_hashed(flat.astype(np.uint64) + np.uint64(1), starts, ends) >> np.uint64(32) | np.uint64(1)
        borders = np.cumsum([len(t) + 1 for t in encoded[:-1]], dtype=np.int64)
        yield from np.split(h, np.searchsorted(starts, borders))

    held, size = [], 0
    for t in texts:
        held.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= CHUNK:
            yield from hashed(held)
            held, size = [], 0
    if held:
        yield from hashed(held)


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    at = np.arange(max(0, len(words) - size + 1))
    return _spans_hashed(words, at, at + size).view(np.int64)


def window_lines(words: np.ndarray, passage: int, line: int) -> np.ndarray:
    """The line of each window of `passage` words, by its first word's place."""
    if len(words) < passage:
        return np.zeros(0, np.int64)
    least, have, want = _windows(words, line).view(np.uint64), 1, passage - line + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least.view(np.int64)


def sections(words: np.ndarray, passage: int) -> list[tuple[int, np.ndarray]]:
    """(first word's place, words) of sections; every window of `passage` words lies in one."""
    step = max(SECTION, 2 * passage) - passage
    return [(at, words[at : at + step + passage]) for at in range(0, max(1, len(words) - passage), step)]


def units(words: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(hashes, borders) of the runs between borders: the least words of all windows of BORDER words."""
    n, inner = len(words), np.zeros(0, np.int64)
    if n >= BORDER:
        mixed = words * np.uint64(BASE)
        inner = np.unique(np.lib.stride_tricks.sliding_window_view(mixed, BORDER).argmin(1) + np.arange(n - BORDER + 1))
    borders = np.unique(np.concatenate(([0], inner, [n])))
    return _spans_hashed(words, borders[:-1], borders[1:]).tolist(), borders


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """Equal values that a and b begin with."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def common_blocks(early: np.ndarray, later: np.ndarray, passage: int) -> list[tuple[int, int]]:
    """Spans of later's words that common blocks of `passage` words or more cover, in order and merged."""
    (ua, pa_), (ub, pb) = units(early), units(later)
    gone, done = np.zeros(len(later) + 1, np.int8), -1
    for i, j in patience_matches(ua, ub):
        if pb[j + 1] <= done:  # inside the last block
            continue
        a, b = int(pa_[i]), int(pb[j])
        back, on = _run(early[:a][::-1], later[:b][::-1]), _run(early[a:], later[b:])
        if back + on >= passage:
            gone[b - back : b + on] = 1
        done = b + on
    if len(later) >= passage and len(early) >= passage:
        inside = np.convolve(gone[:-1], np.ones(passage, np.int32), "valid") if gone.any() else 0
        left = np.flatnonzero((np.zeros(len(later) - passage + 1, np.int32) + inside) < passage)
        if len(left):
            for s in left[np.isin(_windows(later, passage)[left], _windows(early, passage))]:
                gone[s : s + passage] = 1
    edges = np.flatnonzero(np.diff(gone, prepend=0)).tolist()
    return list(zip(edges[::2], edges[1::2], strict=True))


def _sorted_groups(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[np.ndarray]:
    """The batches' columns as the rows of an array of 64-bit integers."""
    for batch in batches:
        if batch.num_rows:
            yield np.stack([batch.column(c).to_numpy().astype(np.int64, copy=False) for c in names])


def _new(rows: np.ndarray, columns: int, last: np.ndarray | None) -> np.ndarray:
    """True where one of the first columns differs from the row before; last: the row before the first."""
    same = (rows[:columns, 1:] == rows[:columns, :-1]).all(0)
    return np.concatenate(([last is None or bool((rows[:columns, 0] != last[:columns]).any())], ~same))


LINE_COLUMNS = ("line", "content", "oid", "sec")


def pair_worker(rare: int):
    """Over rows LINE_COLUMNS, sorted: pairs (oid, key, sec, later_key, later_sec) of rare lines; (line, oid, key, sec) of others.

    Of documents with equal content only the first takes part. Nothing but the rows of one rare line is held.
    """
    names = ["line", "oid", "key", "sec", "later_key", "later_sec"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def frequent(g: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(g.shape[1], pa.int64())
        return pa.RecordBatch.from_arrays([*map(pa.array, (g[0], g[2], g[1] ^ g[2], g[3])), none, none], schema=schema)

    def pairs(g: np.ndarray) -> Iterator[pa.RecordBatch]:
        for step in range(1, rare):
            x, y = g[:, step:], g[:, :-step]
            same = x[0] == y[0]
            if not same.any():
                break
            hit = same & (x[1] != y[1])
            x, y = x[:, hit], y[:, hit]
            # the order of documents: id, then content
            swap = (x[2] < y[2]) | ((x[2] == y[2]) & (x[1] < y[1]))
            early, later = np.where(swap, x, y), np.where(swap, y, x)
            columns = (early[2], early[1] ^ early[2], early[3], later[1] ^ later[2], later[3])
            yield pa.RecordBatch.from_arrays([pa.nulls(early.shape[1], pa.int64()), *map(pa.array, columns)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, first_oid, hot = np.zeros((4, 0), np.int64), None, 0, None
        for rows in _sorted_groups(batches, LINE_COLUMNS):
            fresh = _new(rows, 4, last)  # equal rows of docs have equal lines
            new = _new(rows, 2, last)
            starts = np.flatnonzero(new)
            firsts = np.concatenate(([first_oid], rows[2, starts]))[np.cumsum(new)]
            last, first_oid = rows[:, -1], firsts[-1]
            rows = rows[:, fresh & (rows[2] == firsts)]
            if hot is not None:
                more = int(np.searchsorted(rows[0], hot, side="right"))
                yield frequent(rows[:, :more])
                rows = rows[:, more:]
            rows = np.concatenate((held, rows), 1)
            held = rows[:, :0]
            if not rows.shape[1]:
                continue
            hot = None
            starts = np.flatnonzero(_new(rows, 1, None))
            sizes = np.diff(np.append(starts, rows.shape[1]))
            if sizes[-1] <= rare:  # the last line may go on
                held, rows, sizes = rows[:, starts[-1] :], rows[:, : starts[-1]], sizes[:-1]
            else:
                hot = int(rows[0, -1])
            often = np.repeat(sizes > rare, sizes)
            yield frequent(rows[:, often])
            yield from pairs(rows[:, ~often])
        yield from pairs(held)

    return run


def first_worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (window, oid, key, start), sorted: (key, start, early) of all but a window's first document."""
    last, first = None, np.zeros(4, np.int64)
    for rows in _sorted_groups(batches, ("window", "oid", "key", "start")):
        new = _new(rows, 1, last)
        firsts = np.concatenate((first[:, None], rows[:, new]), 1)[:, np.cumsum(new)]
        last, first = rows[:, -1], firsts[:, -1]
        later = rows[2] != firsts[2]
        yield pa.RecordBatch.from_arrays([pa.array(rows[2, later]), pa.array(rows[3, later].astype(np.int32)), pa.array(firsts[1, later])], ["key", "start", "early"])


def bit_filter(spark: SparkSession, keys: DataFrame, bits: int = FILTER_BITS):
    """A broadcast bit vector of 2^bits bits in which the bit of each key (long) is set: 8 MB, whatever the number of keys."""
    bit = F.pmod(F.col("key"), F.lit(1 << bits))
    slots = keys.groupBy(F.shiftright(bit, 6).alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {1 << bits}) % 64 as int))")).alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[slots.column("slot").to_numpy()] = slots.column("v").to_numpy()
    return spark.sparkContext.broadcast(out)


def _has_bit(vector: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys % (len(vector) * 64)
    return (vector[at >> 6] >> (at & 63)) & 1 == 1


def _merged(spans: Sequence) -> list[dict]:
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [{"start": s, "end": e} for s, e in out]


@F.pandas_udf(SPANS)
def _merge(spans: pd.Series) -> pd.Series:
    return pd.Series([_merged(x) for x in spans], dtype=object)


def cut_text(text: str, spans: Sequence[tuple[int, int]]) -> str:
    """text without the words of spans, each with the white space up to the next word; lines left without a word go whole."""
    out, at, spans = [], 0, list(spans)
    for line in text.split("\n"):
        words = [m.start() for m in WORD.finditer(line)]
        kept, pos, gone = [], 0, 0
        for s, e in spans:
            s, e = max(s - at, 0), min(e - at, len(words))
            if s < e:
                kept.append(line[pos : words[s]])
                pos = words[e] if e < len(words) else len(line)
                gone += e - s
        at += len(words)
        while spans and spans[0][1] <= at:
            spans.pop(0)
        if not words or gone < len(words):
            out.append("".join(kept) + line[pos:])
    return "\n".join(out)


@F.pandas_udf(StringType())
def _cut(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([t if s is None or not len(s) else cut_text(t, list(zip(s, e, strict=True))) for t, s, e in zip(text, starts, ends, strict=True)], dtype=object)


def _digests(words: np.ndarray) -> tuple[int, int]:
    """128 bits of a hash of a document's words, as two signed integers."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(words.tobytes()), np.int64).tolist())


@F.pandas_udf(LongType())
def _contents(texts: pd.Series) -> pd.Series:
    return pd.Series([_digests(w)[0] for w in word_hashes(iter(texts))], dtype="int64")


def _lines(docs: DataFrame, passage: int, line: int) -> DataFrame:
    """A row for each document (line is null) and for each distinct line of a section, stored."""
    names = ["oid", "content", "other", "n_words", "sec", "line"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            oid = batch.column("oid").to_pylist()
            out = [[] for _ in names]
            for o, w in zip(oid, word_hashes(x.as_py() for x in batch.column("text")), strict=True):
                parts = [np.unique(window_lines(x, passage, line)) for _, x in sections(w, passage)] if len(w) >= passage else []
                n = 1 + sum(map(len, parts))
                for column, value in zip(out, (o, *_digests(w), len(w)), strict=False):
                    column.append(np.full(n, value, np.int64))
                out[4].append(np.concatenate((np.full(1, -1), *(np.full(len(p), i) for i, p in enumerate(parts)))))
                out[5].append(np.concatenate((np.zeros(1, np.int64), *parts)))
            if oid:
                sec = np.concatenate(out[4])
                columns = [pa.array(np.concatenate(x)) for x in out[:4]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sec), pa.array(np.concatenate(out[5]), mask=sec < 0)], schema=schema)

    return stored(docs.mapInArrow(run, ", ".join(f"{n} long" for n in names)), "lines")


def _text_lines(docs: DataFrame, least: int) -> DataFrame:
    """(h1, h2, oid, key, start, n): the text lines of `least` words or more by a 128-bit hash of their words, stored."""
    names = ["h1", "h2", "oid", "key", "start", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column("text").to_pylist(), []
            for o, t, w in zip(batch.column("oid").to_pylist(), texts, word_hashes(iter(texts)), strict=True):
                key, at = _digests(w)[0] ^ o, 0
                for line in t.encode("utf-8", "surrogatepass").split(b"\n"):
                    words = line.split()
                    if len(words) >= least:
                        out.append((*np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.int64).tolist(), o, key, at, len(words)))
                    at += len(words)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return stored(docs.mapInArrow(run, ", ".join(f"{n} long" for n in names)), "text_lines")


def _repeated_lines(docs: DataFrame, least: int) -> DataFrame:
    """(key, start, end, early) of the text lines that an earlier document holds, stored."""
    lines = _text_lines(docs, least)
    document = F.struct("oid", "key")
    # a row a line that different documents hold; stored, so that both sides of the join can be split where a line is hot
    held = lines.groupBy("h1", "h2").agg(F.min(document).alias("first"), F.max(document).alias("last"))
    firsts = stored(held.where(F.col("first") < F.col("last")).select("h1", "h2", "first"), "first_lines")
    later = lines.join(firsts, ["h1", "h2"]).where(document > F.col("first"))
    found = stored(later.select("key", F.col("start").cast("int").alias("start"), (F.col("start") + F.col("n")).cast("int").alias("end"), F.col("first.oid").alias("early")), "line_spans")
    discard(lines, firsts)
    return found


def _sections_of(docs: DataFrame, wanted: DataFrame, passage: int, repeated: bool) -> DataFrame:
    """(key, sec, first, words) of the sections wanted (oid, key, sec), and of a few others, stored. words: 32-bit hashes."""
    spark = docs.sparkSession
    ids = bit_filter(spark, wanted.select(F.col("oid").alias("key")).distinct())
    marks = bit_filter(spark, wanted.select(F.col("key").bitwiseXOR(F.col("sec") * SPREAD).alias("key")))
    schema = pa.schema({"key": pa.int64(), "sec": pa.int64(), "first": pa.int32(), "words": pa.binary()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_has_bit(ids.value, batch.column("oid").to_numpy())))
            out = []
            for o, w in zip(batch.column("oid").to_pylist(), word_hashes(x.as_py() for x in batch.column("text")), strict=True):
                key, parts = _digests(w)[0] ^ o, sections(w, passage)
                for i in np.flatnonzero(_has_bit(marks.value, key ^ np.arange(len(parts)) * SPREAD)).tolist():
                    out.append((key, i, parts[i][0], parts[i][1].astype(np.uint32).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    found = docs.mapInArrow(run, "key long, sec long, first int, words binary")
    return stored(found.dropDuplicates(["key", "sec"]) if repeated else found, "sections")


def _unpacked(words: bytes) -> np.ndarray:
    return np.frombuffer(words, np.uint32).astype(np.uint64)


def _oid(docs: DataFrame) -> Column:
    """The id as it orders documents: the greatest long for null."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID))


def removed_spans(docs: DataFrame, passage: int = PASSAGE, line: int = LINE, whole_lines: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, key (of the id and the words), nth (1, 2, ... of rows with equal keys), n_words,
    removed_words, sources (doc_ids of the earlier documents that hold the blocks), spans (start and end of removed words,
    end exclusive).

    Documents are ordered by doc_id, null last, ties by a hash of their words. Null and empty texts have no words; of
    rows with one id and the same words all but the first lose everything, as copies of `passage` words or more do; no
    rows give no rows; other columns are ignored. With whole_lines, text lines of so many words or more that an earlier
    document holds go too; a line that only one document repeats stays.
    """
    if not 1 <= line < passage:
        raise ValueError("a line has fewer words than a passage")
    each = docs.select(_oid(docs).alias("oid"), text_of().alias("text"))
    rows = _lines(each, passage, line)
    key = F.col("content").bitwiseXOR(F.col("oid")).alias("key")
    wholes = rows.where("line is null").groupBy("oid", "content", "other", "n_words").agg(F.count("*").alias("n"))
    wholes = stored(wholes.withColumn("key", key), "wholes")
    dealt = rows.where("line is not null").select(*LINE_COLUMNS).repartition("line").sortWithinPartitions(*LINE_COLUMNS)
    met = stored(dealt.mapInArrow(pair_worker(RARE), "line long, oid long, key long, sec long, later_key long, later_sec long"), "met")
    discard(rows)

    firsts = wholes.groupBy("content", "other", "n_words").agg(F.min("oid").alias("early"))
    copies = wholes.join(firsts, ["content", "other", "n_words"]).where((F.col("oid") > F.col("early")) & (F.col("n_words") >= passage))
    copies = copies.select("key", F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"), "early")
    pairs = stored(met.where("line is null").drop("line").distinct(), "pairs")
    often = met.where("line is not null").select("line", "oid", "key", "sec")
    # a later document's id is not among a pair's columns, but follows from its key and its words
    names = wholes.select("key", "oid").join(pairs.select(F.col("later_key").alias("key"), F.col("later_sec").alias("sec")), "key")
    wanted = pairs.select("oid", "key", "sec").unionAll(names.select("oid", "key", "sec")).unionAll(often.select("oid", "key", "sec"))
    words = _sections_of(each, wanted, passage, not wholes.where("n > 1").isEmpty())

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, first, oid, a, b in zip(pdf["later_key"], pdf["first"], pdf["oid"], pdf["early_words"], pdf["words"], strict=True):
                out += [(key, first + s, first + e, oid) for s, e in common_blocks(_unpacked(a), _unpacked(b), passage)]
            yield pd.DataFrame(out, columns=["key", "start", "end", "early"])

    # all uses of the words take the same columns, so that one exchange of them serves all
    early = pairs.join(words, ["key", "sec"]).select("later_key", "later_sec", "oid", F.col("first").alias("early_first"), F.col("words").alias("early_words"))
    both = early.join(words, (F.col("later_key") == words["key"]) & (F.col("later_sec") == words["sec"]))
    aligned = both.select("later_key", "first", "oid", "early_first", "early_words", "words").mapInPandas(align, "key long, start int, end int, early long")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, oid, first, some, w in zip(pdf["key"], pdf["oid"], pdf["first"], pdf["lines"], pdf["words"], strict=True):
                w = _unpacked(w)
                at = np.flatnonzero(np.isin(window_lines(w, passage, line), some))
                yield pd.DataFrame({"window": _windows(w, passage)[at], "oid": oid, "key": key, "start": (first + at).astype(np.int32)})

    # a section's own lines: no more than its words
    frequent = words.join(often.groupBy("key", "sec", "oid").agg(F.collect_list("line").alias("lines")), ["key", "sec"])
    placed = frequent.select("key", "oid", "first", "lines", "words").mapInPandas(windows, "window long, oid long, key long, start int")
    placed = placed.repartition("window").sortWithinPartitions("window", "oid", "key", "start")
    looked = placed.mapInArrow(first_worker, "key long, start int, early long").select("key", "start", (F.col("start") + passage).alias("end"), "early")

    found = copies.unionAll(aligned).unionAll(looked)
    if whole_lines:
        found = found.unionAll(repeated := _repeated_lines(each, whole_lines))
    early = F.sort_array(F.collect_set(F.when(F.col("early") != NO_ID, F.col("early"))))
    cut = stored(found.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("all"), early.alias("sources")), "cut")
    discard(met, pairs, words, *([repeated] if whole_lines else []))
    cut = cut.select("key", _merge("all").alias("spans"), "sources")

    out = wholes.select("key", "oid", "n_words", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth")).join(cut, "key", "left")
    again = (F.col("nth") > 1) & (F.col("n_words") >= passage)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    doc_id = F.when(F.col("oid") != NO_ID, F.col("oid"))
    own = F.coalesce("sources", F.array().cast("array<bigint>"))
    out = out.withColumn("spans", F.when(again, whole).otherwise(F.coalesce("spans", F.array().cast(SPANS))))
    sources = F.when(again & doc_id.isNotNull(), F.array_union(own, F.array(doc_id))).otherwise(own)
    words_gone = F.aggregate("spans", F.lit(0).cast("long"), lambda x, s: x + s["end"] - s["start"])
    return out.select(doc_id.alias("doc_id"), "key", "nth", "n_words", words_gone.alias("removed_words"), sources.alias("sources"), "spans")


def dedup_lines(docs: DataFrame, passage: int = PASSAGE, line: int = LINE, whole_lines: int | None = None) -> DataFrame:
    """docs with a column clean_text: the text without its removed words (see removed_spans()).

    Of repeated rows one keeps its text, any of them where other columns differ. A column of that name in docs is replaced,
    null texts stay null, empty texts empty, texts of any length are cut whole, and no rows give no rows.
    """
    docs = docs.drop("clean_text")
    key, nth = free_name(docs, "k_key"), free_name(docs, "k_nth")
    cuts = stored(removed_spans(docs, passage, line, whole_lines).where(F.size("spans") > 0).select(F.col("key").alias(key), F.col("nth").cast("int").alias(nth), "spans"), "removed").alias("f")
    numbered = docs.withColumn(key, _contents(text_of()).bitwiseXOR(_oid(docs))).withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))).alias("d")
    both = numbered.join(cuts, [key, nth], "left")
    clean = F.when(F.col("f.spans").isNull(), F.col("d.text")).otherwise(_cut(F.col("d.text"), F.col("f.spans.start"), F.col("f.spans.end")))
    return both.select(*[F.col(f"d.{c}") for c in docs.columns], clean.alias("clean_text"))
