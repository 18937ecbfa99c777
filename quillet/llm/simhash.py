"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into fewer segments than there are differing bits allowed: three for four bits, so that of any
two linked fingerprints one segment differs by at most one bit. Each segment is indexed once for every position with that
position deleted (a wildcard); two segments within one bit share a variant, and equality on variants finds them.

Dense groups are contracted first: equal whole segments, three keys a fingerprint, link each fingerprint to up to four
centres of its bucket, and what that links is merged. Then the variants are shuffled once, sorted by key, and each worker
passes over its buckets as they come. Only pairs of different components are looked at, and in a bucket whose members
mostly belong to one component only the others are compared with all. A bucket above `held` members is not compared in one
task: its members are written out and joined in salted parts. So no bucket is collected, and no link between different
components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import discard, free_name, stored, text_of
from .components import connected_components

SEED = 42
BLOCK = 1 << 15
#: (blocks, take): segments are all unions of `take` of `blocks` nearly equal blocks of the bits. Three plain segments are
#: the method; more and longer ones ((5, 2), (6, 3)) make fewer chance meetings at more variants a fingerprint.
LAYOUT = (3, 1)
#: Members of one bucket that a task compares by itself, rows that it gathers before it looks at their buckets, size up to
#: which buckets are compared all at once, and parts that larger buckets than `held` are dealt to.
HELD, GATHERED, SMALL, SALTS = 20_000, 1 << 18, 32, 64


def fingerprint_text(text: str | None, words_per_shingle: int = 5) -> int:
    """Signed 64-bit SimHash of the word shingles of a text; 0 if it has no words. Long texts are summed in blocks."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h, n = xxhash.xxh64_intdigest, len(words) - k + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        spans = zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist(), strict=True)
        hashes = np.array([h(joined[s:e], SEED) for s, e in spans], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(text: Column, words_per_shingle: int) -> Column:
    @F.pandas_udf(LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_text(x, words_per_shingle) for x in texts], dtype="int64")

    return run(text)


def segments(blocks: int, take: int) -> list[list[tuple[int, int]]]:
    """The segments as lists of (lowest bit, bits)."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [[(edges[i], edges[i + 1] - edges[i]) for i in chosen] for chosen in combinations(range(blocks), take)]


def most_bits(layout: tuple[int, int]) -> int:
    """Differing bits up to which some segment of the layout differs by at most one: what it finds without loss."""
    blocks, take = layout
    return 2 * blocks - 1 if take == 1 else blocks - take + 1


def _packed(segment: list[tuple[int, int]]) -> tuple[Column, int]:
    """(the segment's bits side by side, their number)."""
    out, size = F.lit(0).cast("long"), 0
    for low, bits in segment:
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1))
        out, size = out.bitwiseOR(F.shiftleft(part, size)), size + bits
    return out, size


def _keyed(prints: DataFrame, layout: tuple[int, int], wildcard: bool) -> DataFrame:
    """prints with a row for each segment's key, or for each variant's. Keys are the bits themselves with the variant's number above."""
    keys = []
    found = [_packed(s) for s in segments(*layout)]
    room = max(size for _, size in found)
    for value, size in found:
        for rest in [value.bitwiseAND(F.lit(~(1 << b))) for b in range(size)] if wildcard else [value]:
            keys.append(rest.bitwiseOR(F.lit(len(keys) << room)))
    return prints.select("*", F.explode(F.array(*keys)).alias("key"))


def _near(a: Column, b: Column, bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= bits


def _unique_pairs(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.unique(np.stack((np.minimum(u, v), np.maximum(u, v)), 1), axis=0)


def bucket_links(key: np.ndarray, fp: np.ndarray, root: np.ndarray, bits: int) -> np.ndarray:
    """Pairs of different roots that whole buckets (rows sorted by key) link, each once."""
    out = [np.zeros((0, 2), np.int64)]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    mixed = (np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)) if len(starts) else sizes > 0
    # small buckets: all rows against those 1, 2, ... places behind, of all buckets at once
    rows = np.repeat(mixed & (sizes <= SMALL), sizes)
    fp = fp.view(np.uint64)  # the bits of negative numbers count as they are
    k, f, r = key[rows], fp[rows], root[rows]
    for step in range(1, SMALL):
        same = k[step:] == k[:-step]
        if not same.any():
            break
        hit = same & (r[step:] != r[:-step]) & (np.bitwise_count(f[step:] ^ f[:-step]) <= bits)
        out.append(_unique_pairs(r[step:][hit], r[:-step][hit]))
    # large ones: the members outside the largest component against all, a block at a time
    for at in np.flatnonzero(mixed & (sizes > SMALL)):
        f, r = (x[starts[at] : starts[at] + sizes[at]] for x in (fp, root))
        names, n = np.unique(r, return_counts=True)
        other = np.flatnonzero(r != names[n.argmax()])
        block = max(1, (1 << 22) // len(f))
        for i in range(0, len(other), block):
            some = other[i : i + block]
            a, b = np.nonzero((np.bitwise_count(f[some, None] ^ f[None, :]) <= bits) & (r[some, None] != r[None, :]))
            out.append(_unique_pairs(r[some[a]], r[b]))
    return np.unique(np.concatenate(out), axis=0)


def _bucket_worker(bits: int, held: int):
    """Over rows (key, fp, root) sorted by key: links (u, v) of roots; members (key, u: fp, v: root) of buckets above held."""
    schema = pa.schema({"key": pa.int64(), "u": pa.int64(), "v": pa.int64()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # tail: rows of the last bucket, which may go on; mixed: it has two roots; large: its key, once it is written out
        kept, size, tail, mixed, large = [], 0, 0, False, None

        def links(rows: np.ndarray) -> pa.RecordBatch:
            found = bucket_links(*rows, bits)
            return pa.RecordBatch.from_arrays([pa.nulls(len(found), pa.int64()), *map(pa.array, found.T)], schema=schema)

        def members(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], schema=schema)

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("key", "fp", "root")])  # sorted by key
            if large is not None:
                more = int(np.searchsorted(rows[0], large, side="right"))
                yield members(rows[:, :more])
                rows = rows[:, more:]
            if not rows.shape[1]:
                continue
            large = None
            last = int(np.searchsorted(rows[0], rows[0, -1]))
            new = rows[2, last:]
            if last or not kept or kept[-1][0, -1] != rows[0, -1]:
                tail, mixed = 0, False
                before = new[0]
            else:
                before = kept[-1][2, -1]
            tail, mixed = tail + len(new), mixed or bool((new != before).any())
            kept.append(rows)
            size += rows.shape[1]
            over = tail > (held if mixed else 50 * held)  # members of one component only wait longer: they may need nothing
            if over or size - tail >= GATHERED:
                rows = np.concatenate(kept, 1)
                if size > tail:
                    yield links(rows[:, : size - tail])
                kept, size = [rows[:, size - tail :]], tail
                if over:
                    yield members(kept[0])
                    large, kept, size, tail, mixed = int(kept[0][0, 0]), [], 0, 0, False
        if kept:
            yield links(np.concatenate(kept, 1))

    return run


def print_components(prints: DataFrame, bits: int = 4, layout: tuple[int, int] = LAYOUT, held: int = HELD) -> DataFrame:
    """prints (fp), distinct -> (node, root) of every fingerprint that has a link."""
    if bits > most_bits(layout):
        raise ValueError(f"segments of the layout {layout} find links of {most_bits(layout)} differing bits at most, not {bits}")
    whole = _keyed(prints, layout, False)
    centres = F.array_distinct(F.array(F.min("fp"), F.max("fp"), F.min_by("fp", F.xxhash64("fp")), F.max_by("fp", F.xxhash64("fp"))))
    buckets = whole.groupBy("key").agg(centres.alias("centres"), F.count("*").alias("n")).where("n > 1")
    linked = lambda c: (c != F.col("fp")) & _near(c, F.col("fp"), bits)
    first = whole.join(buckets, (whole["key"] == buckets["key"]) & F.exists("centres", linked))
    star = stored(first.select(F.col("fp").alias("u"), F.explode(F.filter("centres", linked)).alias("v")).distinct(), "star")
    comps = connected_components(star)

    named = prints.join(comps, prints["fp"] == comps["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    dealt = _keyed(named, layout, True).select("key", "fp", "root").repartition("key").sortWithinPartitions("key")
    met = stored(dealt.mapInArrow(_bucket_worker(bits, held), "key long, u long, v long"), "met")
    links = met.where("key is null").select("u", "v")
    large = met.where("key is not null").select("key", F.col("u").alias("fp"), F.col("v").alias("root"))
    if not large.isEmpty():
        share = large.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("major"))
        other = large.join(share, "key").where("root != major").select("key", F.col("fp").alias("fa"), F.col("root").alias("u"), F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("salt"))
        every = large.select("key", F.col("fp").alias("fb"), F.col("root").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        cross = other.join(every, ["key", "salt"]).where((F.col("u") != F.col("v")) & _near(F.col("fa"), F.col("fb"), bits))
        links = links.unionAll(cross.select("u", "v"))
    cross = stored(links.distinct(), "cross")
    discard(met, star)
    if cross.isEmpty():
        return comps
    found = connected_components(comps.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(cross))
    return found


def near_duplicates(docs: DataFrame, bits: int = 4, words_per_shingle: int = 5, layout: tuple[int, int] = LAYOUT) -> DataFrame:
    """One row per row of docs: doc_id, text_key, fp (long), fingerprint (16 hex digits), component_id, root.

    component_id is the least doc_id of the component, root the fingerprint that names it (never null). Null and empty texts have fingerprint 0 and are linked like any
    other; null doc_ids take part and never become an id unless a component has nothing else; repeated rows are repeated;
    no rows give no rows; other columns are ignored.
    """
    each = stored(docs.select("doc_id", F.xxhash64(text_of()).alias("text_key"), fingerprints(F.col("text"), words_per_shingle).alias("fp")), "prints")
    prints = stored(each.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    comps = print_components(prints.select("fp"), bits, layout)
    rooted = stored(prints.join(comps, prints["fp"] == comps["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id", "root")
    return each.join(named, "fp", "left").select("doc_id", "text_key", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def keep_one_per_group(docs: DataFrame, bits: int = 4, words_per_shingle: int = 5) -> DataFrame:
    """The rows of docs with all but one of each component left out: the least doc_id stays, ties by text hash.

    Null and empty texts have fingerprint zero and are one component with all that is near it; a null doc_id stays only if its
    component has no other; of rows equal in id and text one stays; texts of any length are compared whole; extra columns
    pass through whatever their names; no rows give no rows.
    """
    found = stored(near_duplicates(docs, bits, words_per_shingle).select("doc_id", "text_key", "root"), "groups")
    a, b = free_name(docs, "k_id"), free_name(docs, "k_text")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    stay = found.groupBy("root").agg(F.min(order).alias("o"), F.count("*").alias("n")).select(F.col("o.doc_id").alias(a), F.col("o.text_key").alias(b))
    stay = stored(stay, "stay")
    out = docs.join(stay, docs["doc_id"].eqNullSafe(stay[a]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == stay[b]), "left_semi")
    if found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return out
    return out.withColumn(b, F.xxhash64(text_of())).dropDuplicates(["doc_id", b]).drop(b)
