"""Benchmark decontamination with a distributed positional inverted index. DataFrame functions only.

A first pass counts the terms of the benchmark in the training texts; the index then stores postings (term, doc, pos) of the
terms that are looked up, the rarest of each window and item, and of no others. Of each window
of an item the two rarest terms are intersected, in ascending frequency: the postings of the rarest, adjusted by its offset
in the item, say where the second must stand, and only alignments that the second's postings confirm go on. Those few are
compared word for word with the document; texts without an alignment stay where they are. Proximity matches come from the same postings: an item's rarest terms, in any
order, within a few words.

Documents are known by a 64-bit hash of doc_id and text, terms by one of the word. Tables of looked-up terms are broadcast
up to BROADCAST_ROWS rows of a few numbers each, which is counted first; beyond, they are joined, and every term's postings
are dealt to SALTS parts, so that the commonest word is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, free_name, let, stored, text_of

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
SALTS, BROADCAST_ROWS, FILTER_BITS = 16, 200_000, 27
SLOP, NEAR_TERMS = 20, 3


def item_words(text: Column) -> Column:
    """Lower-cased words of a non-null text: runs of ASCII letters, digits and all characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def doc_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], F.coalesce(docs["text"], F.lit("")))


def _items(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, item, words, size): one row for each distinct item_id and word sequence with words; item is its hash."""
    words = benchmark.select("item_id", item_words(text_of()).alias("words"))
    sized = words.where(F.size("words") > 0).distinct().withColumn("size", F.least(F.lit(window), F.size("words")))
    return sized.withColumn("item", F.xxhash64("item_id", "words"))


class Index:
    """items, their terms' frequency in docs (term, word, n), and postings (term, doc, pos from 0) of the terms gathered."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> None:
        self.items = stored(_items(benchmark, window), "items")
        words = self.items.select(F.explode("words").alias("word")).distinct().select(F.xxhash64("word").alias("term"), "word")
        self.vocabulary = stored(words, "vocabulary")
        split = docs.select(doc_key(docs).alias("doc"), item_words(text_of()).alias("w"))
        self.places = split.select("doc", F.posexplode("w").alias("pos", "word")).select(F.xxhash64("word").alias("term"), "doc", "pos")
        # Spark broadcasts the vocabulary only if its stored size is under spark.sql.autoBroadcastJoinThreshold
        counts = self._among(self.vocabulary).groupBy("term").agg(F.count("*").alias("n"))
        self.frequency = stored(self.vocabulary.join(counts, "term"), "frequency")
        self.postings: DataFrame | None = None

    def _among(self, terms: DataFrame) -> DataFrame:
        return self.places.join(terms.select("term").distinct(), "term")

    def gather(self, *terms: DataFrame) -> None:
        """Stores the postings of terms (term), null ones left out."""
        wanted = terms[0]
        for more in terms[1:]:
            wanted = wanted.unionAll(more)
        wanted = stored(wanted.where("term is not null").distinct(), "gathered")
        self.postings = stored(self._among(wanted), "postings")
        discard(wanted)

    def of(self, terms: DataFrame) -> DataFrame:
        """terms (term, numbers) with doc and pos of each posting."""
        terms = stored(terms, "terms")
        if terms.count() <= BROADCAST_ROWS:
            return self.postings.join(F.broadcast(terms), "term")
        part, parts = F.pmod(F.col("doc"), F.lit(SALTS)).alias("part"), F.array(*[F.lit(i).cast("long") for i in range(SALTS)])
        return self.postings.select("term", "doc", "pos", part).join(terms.withColumn("part", F.explode(parts)), ["term", "part"]).drop("part")

    def close(self) -> None:
        """Deletes the index; what was made of it must be stored."""
        discard(self.items, self.vocabulary, self.frequency, *([self.postings] if self.postings else []))


def windows(index: Index) -> DataFrame:
    """(item, start, size, text, term, at, second, second_at): of each window that documents may hold its two rarest terms.

    at is the place in the item; a window of one word has no second term.
    """
    start = F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))).alias("start")
    each = index.items.select("item", "words", "size", start)
    text = each.select("item", "start", "size", F.array_join(F.slice("words", F.col("start") + 1, "size"), " ").alias("text"))
    place = each.select("item", "start", F.posexplode(F.slice("words", F.col("start") + 1, "size")).alias("i", "word"))
    counted = place.join(index.frequency.select("word", "term", "n"), "word", "left")
    rarest = F.sort_array(F.collect_list(F.struct("n", "i", "term")))  # as many as the window has words
    two = counted.groupBy("item", "start").agg(rarest.alias("r"), F.count_if(F.col("n").isNull()).alias("unseen")).where("unseen = 0")
    at = lambda i: (F.get("r", F.lit(i))["i"] + F.col("start"))
    both = two.select("item", "start", F.col("r")[0]["term"].alias("term"), at(0).alias("at"), F.get("r", F.lit(1))["term"].alias("second"), at(1).alias("second_at"))
    return text.join(both, ["item", "start"])


def alignments(index: Index, wanted: DataFrame) -> DataFrame:
    """(doc, item, at, second_at, base): the item's first word would lie at position base of the document."""
    pairs = wanted.select("item", "term", "at", "second", "second_at").distinct()
    first = index.of(pairs).select("doc", "item", "at", "second", "second_at", (F.col("pos") - F.col("at")).alias("base")).distinct()
    alone = first.where("second is null").select("doc", "item", "at", "second_at", "base")
    seconds = wanted.select(F.col("second").alias("term")).where("term is not null").distinct()
    confirm = index.of(seconds).select(F.col("doc").alias("d"), F.col("term").alias("t"), F.col("pos").alias("p"))
    stands = (F.col("doc") == F.col("d")) & (F.col("second") == F.col("t")) & (F.col("base") + F.col("second_at") == F.col("p"))
    both = first.where("second is not null").join(confirm, stands, "left_semi")
    return both.select("doc", "item", "at", "second_at", "base").unionAll(alone)


def _covered(spans: Column) -> Column:
    """Words in a union of [start, end) structs."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    return F.aggregate(F.sort_array(spans), zero, step, lambda a: a["n"])


def looked_up(wanted: DataFrame) -> list[DataFrame]:
    """The terms that phrase_matches() looks up for windows()."""
    return [wanted.select("term"), wanted.select(F.col("second").alias("term"))]


def may_hold(rows: DataFrame, key: str, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose key (a hash) is among keys, and a few others: a bit map of 2**bits slots, at most 2**(bits - 3) bytes, is
    broadcast, and a row whose slot is empty goes. With more keys than slots nearly all rows stay."""
    slot, bucket, of = free_name(rows, "slot"), free_name(rows, "bucket"), free_name(rows, "map_of")
    number = F.pmod(F.col(key), F.lit(1 << bits)) + 1
    filled = keys.select(number.alias("n")).groupBy(F.bitmap_bucket_number("n").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias(of))
    placed = rows.withColumn(slot, F.bitmap_bit_position(number)).withColumn(bucket, F.bitmap_bucket_number(number))
    byte = F.conv(F.hex(F.substring(F.col(of), F.shiftright(slot, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_bits = F.array(*[F.shiftright(byte, i).bitwiseAND(1) for i in range(8)])
    return placed.join(F.broadcast(filled), bucket).where(F.get(set_bits, (F.col(slot) % 8).cast("int")) == 1).select(*rows.columns)


def phrase_matches(docs: DataFrame, index: Index, wanted: DataFrame) -> DataFrame:
    """Exact matches of stored windows(): doc, item_id, start, end (word positions, end exclusive), one row for each window, stored.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window.
    """
    aligned, w = alignments(index, wanted).alias("a"), wanted.alias("w")
    same = (F.col("a.item") == F.col("w.item")) & (F.col("a.at") == F.col("w.at")) & F.col("a.second_at").eqNullSafe(F.col("w.second_at"))
    tries = aligned.join(w, same).select("doc", "w.item", "start", "size", (F.col("base") + F.col("start")).alias("first")).where("first >= 0")
    # to each document its own alignments, numbers only: as many as it has places of rare terms
    tries = stored(tries.groupBy("doc").agg(F.collect_set(F.struct("item", "start", "size", "first")).alias("try")), "tries")
    texts = docs.select(doc_key(docs).alias("doc"), text_of().alias("text"))
    # only texts that may have an alignment are dealt out, and always: what is moved does not hang on what Spark broadcasts
    split = may_hold(texts, "doc", tries).join(tries.hint("merge"), "doc").select("doc", item_words(F.col("text")).alias("w"), "try")
    piece = lambda w: F.transform("try", lambda t: F.struct(t["item"].alias("item"), t["start"].alias("start"), t["first"].alias("first"), (t["first"] + t["size"]).alias("end"), F.array_join(F.slice(w, t["first"] + 1, t["size"]), " ").alias("text")))
    pieces = split.select("doc", F.explode(let(F.col("w"), piece)).alias("p")).select("doc", "p.*")
    named = wanted.select("item", "start", "text").join(index.items.select("item", "item_id"), "item")
    hits = stored(pieces.join(named, ["item", "start", "text"]).select("doc", "item_id", F.col("first").alias("start"), "end").distinct(), "matches")
    discard(wanted, tries)
    return hits


def rarest_terms(index: Index, terms: int = NEAR_TERMS) -> DataFrame:
    """(item_id, item, r), stored: of the terms that documents hold an item's rarest, ties by the word; two at least."""
    words = index.items.select("item_id", "item", F.explode(F.array_distinct("words")).alias("word"))
    ranked = F.slice(F.sort_array(F.collect_list(F.struct("n", "word", "term"))), 1, terms)
    return stored(words.join(index.frequency, "word").groupBy("item_id", "item").agg(ranked.alias("r")).where(F.size("r") > 1), "ranked")


def proximity_matches(index: Index, slop: int = SLOP, terms: int = NEAR_TERMS, r: DataFrame | None = None) -> DataFrame:
    """(doc, item_id, first, last): the terms of rarest_terms(), in any order, within `slop` words.

    For each place of the rarest the narrowest stretch that holds all is taken, the first of equal ones: of each
    other term the nearest place before and the nearest behind are tried in all combinations that can be narrowest.
    """
    r = r or rarest_terms(index, terms)
    if index.postings is None:
        index.gather(r.select(F.explode("r.term").alias("term")))
    first = r.select("item_id", "item", F.size("r").alias("k"), F.col("r")[0]["term"].alias("term"))
    rest = r.select("item", F.explode(F.slice("r", 2, terms)).alias("x")).select("item", F.col("x.term").alias("term"))
    cell = F.floor(F.col("pos") / slop)
    # cells of slop words turn the range condition into an equality
    centre = index.of(first).select("doc", "item_id", "item", "k", F.col("pos").alias("centre"), cell.alias("cell")).distinct()
    near = index.of(rest).select("doc", "item", "term", "pos", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    met = centre.join(near, ["doc", "item", "cell"]).where(F.abs(F.col("pos") - F.col("centre")) < slop)
    before, behind = F.max(F.when(F.col("pos") < F.col("centre"), F.col("pos"))), F.min(F.when(F.col("pos") > F.col("centre"), F.col("pos")))
    sides = met.groupBy("doc", "item_id", "item", "k", "centre", "term").agg(before.alias("l"), behind.alias("r"))
    whole = sides.groupBy("doc", "item_id", "item", "k", "centre").agg(F.collect_list(F.struct("l", "r")).alias("s")).where(F.size("s") == F.col("k") - 1)

    def stretch(begin: Column) -> Column:
        """(length, first, last) of the narrowest stretch from begin on, null if a term is missing there."""
        ends = F.transform("s", lambda x: F.when(x["l"] >= begin, F.col("centre")).otherwise(x["r"]))
        last = F.when(~F.exists(ends, lambda e: e.isNull()), F.array_max(ends))
        return F.when(last.isNotNull(), F.struct((last - begin).alias("length"), begin.alias("first"), last.alias("last")))

    begins = F.filter(F.concat(F.array("centre"), F.transform("s", lambda x: x["l"])), lambda b: b.isNotNull())
    best = F.array_min(F.filter(F.transform(begins, stretch), lambda x: x.isNotNull()))
    out = whole.select("doc", "item_id", best.alias("b")).where(F.col("b.length") < slop)
    return out.select("doc", "item_id", F.col("b.first").alias("first"), F.col("b.last").alias("last")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, near_sha256.

    A word inside any occurrence of a window is hit. n_near counts the items with a proximity match, near_sha256 is the
    digest of their ids. Null and empty texts have no words; repeated items count once for each distinct item_id, a null
    item_id is found but not listed; repeated rows of docs get equal rows; empty tables give no rows or no hits; columns
    beyond doc_id and text (item_id and text) are ignored.
    """
    index = Index(docs, benchmark, window)
    wanted, r = stored(windows(index), "windows"), rarest_terms(index)
    index.gather(*looked_up(wanted), r.select(F.explode("r.term").alias("term")))
    matches = phrase_matches(docs, index, wanted)
    span = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    ids = F.sort_array(F.collect_set(F.col("item_id").cast("string")))
    exact = matches.groupBy("doc").agg(F.collect_set(span).alias("spans"), ids.alias("ids")).select("doc", _covered(F.col("spans")).alias("n_hit"), "ids")
    near = proximity_matches(index, r=r).groupBy("doc").agg(ids.alias("near"))
    hit = stored(exact.join(near, "doc", "full_outer"), "hits")
    index.close()
    discard(matches, r)
    base = docs.select("doc_id", doc_key(docs).alias("doc"), F.size(item_words(text_of())).cast("long").alias("n_words"))
    both = base.join(hit, "doc", "left")
    n_hit, none = F.coalesce("n_hit", F.lit(0)).cast("long"), F.array().cast("array<string>")
    listed, close = F.coalesce("ids", none), F.coalesce("near", none)
    digest = lambda x: F.sha2(F.array_join(x, ","), 256)
    return both.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), digest(listed).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.size(close).cast("long").alias("n_near"), digest(close).alias("near_sha256"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no window of any item, with all their columns.

    Null and empty texts hold none and stay, as does every repeated row without one; an empty benchmark drops nothing; extra
    columns pass through whatever their names.
    """
    index, name = Index(docs, benchmark, window), free_name(docs, "k_doc")
    wanted = stored(windows(index), "windows")
    index.gather(*looked_up(wanted))
    bad = stored(phrase_matches(docs, index, wanted).select(F.col("doc").alias(name)).distinct(), "leaks")
    index.close()
    return docs.join(bad, doc_key(docs) == bad[name], "left_anti")
