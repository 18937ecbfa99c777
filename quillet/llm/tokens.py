"""Token-id files with Elias-Fano document boundaries.

A shard file holds one contiguous run of documents in ascending doc_id order (all integers little-endian):

    magic   8 bytes  b"QLTOKEF2"
    header  u64 documents, u64 documents without an id (they come first), i64 least doc_id, u64 tokens, u64 bytes an id (2 or 4)
    doc ids          a sequence: each id less the least one
    ends             a sequence: the place behind each document's last id
    ids              tokens x u16 or u32, concatenated, each document closed by the end id

A sequence of n non-decreasing integers up to u is stored by Elias (1974) and Fano (1971): u64 low bits l, u64 bytes of the
low part, of the high part and of the directory; the low part, l bits a value; the high part, where value i sets bit
(value >> l) + i; the directory, the bit's place for every 256th value as u32 or, where that is too small, u64 (its width
follows from its size). That is about n * (2 + log2(u / n)) bits. `select` finds values through the directory, without
decoding others and without a table of them.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, stored, text_of

MAGIC = b"QLTOKEF2"
HEADER = struct.Struct("<QQqQQ")
SEQUENCE = struct.Struct("<QQQQ")
SAMPLED = 256
#: Words kept in a worker's cache of encoded words, their greatest length in characters (longer ones are encoded each
#: time), and bytes of ids after which a shard file is closed.
CACHE_WORDS = 600_000
CACHE_CHARS = 64
SHARD_BYTES = 32 << 20


class EliasFano:
    """A non-decreasing sequence of n integers from 0 on, with select."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, directory: bytes) -> None:
        self.n, self.low_bits, self.low, self.high, self.directory = n, low_bits, low, high, directory
        samples = -(-n // SAMPLED)
        self.places = np.frombuffer(directory, "<u8" if len(directory) == 8 * samples else "<u4")

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values).astype(np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        parts = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(parts.astype(np.uint8).ravel(), bitorder="little").tobytes()
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1, np.uint8)
        high[at] = 1
        wide = "<u4" if int(at[-1]) < 1 << 32 else "<u8"
        return cls(n, low_bits, low, np.packbits(high, bitorder="little").tobytes(), at[::SAMPLED].astype(wide).tobytes())

    def packed(self) -> bytes:
        return SEQUENCE.pack(self.low_bits, len(self.low), len(self.high), len(self.directory)) + self.low + self.high + self.directory

    @classmethod
    def unpack(cls, data: memoryview, at: int, n: int) -> tuple[EliasFano, int]:
        """(the sequence of n values that begins at `at`, the place behind it)."""
        low_bits, *sizes = SEQUENCE.unpack_from(data, at)
        ends = np.cumsum([at + SEQUENCE.size, *sizes]).tolist()
        return cls(n, low_bits, *(bytes(data[s:e]) for s, e in zip(ends, ends[1:], strict=False))), ends[-1]

    def _lows(self, first: int, to: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(to - first, np.uint64)
        begin, end = first * self.low_bits, to * self.low_bits
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8, -(-end // 8) - begin // 8, begin // 8), bitorder="little")
        rows = bits[begin % 8 : begin % 8 + end - begin].reshape(to - first, self.low_bits)
        return rows.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def block(self, b: int) -> np.ndarray:
        """Values SAMPLED * b and following, up to the next sample, as unsigned 64-bit integers."""
        first, to = b * SAMPLED, min(self.n, (b + 1) * SAMPLED)
        start = int(self.places[b])
        stop = int(self.places[b + 1]) if to < self.n else 8 * len(self.high)
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8, -(-stop // 8) - start // 8, start // 8), bitorder="little")
        places = start // 8 * 8 + np.flatnonzero(bits)
        places = places[np.searchsorted(places, start) :][: to - first]
        return (places - np.arange(first, to)).astype(np.uint64) << np.uint64(self.low_bits) | self._lows(first, to)

    def select(self, i: int) -> int:
        """The i-th value: one entry of the directory, and the bits from there to the next."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.block(i // SAMPLED)[i % SAMPLED])

    def blocks(self) -> Iterator[np.ndarray]:
        """All values, a block at a time."""
        return map(self.block, range(-(-self.n // SAMPLED)))


def encode_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The file's bytes. doc_ids ascend, None first."""
    named = [x for x in doc_ids if x is not None]
    least = named[0] if named else 0
    keys = EliasFano.encode(np.array([x - least for x in named], np.uint64))
    ends = EliasFano.encode(np.cumsum(lengths, dtype=np.int64))
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    header = HEADER.pack(len(doc_ids), len(doc_ids) - len(named), least, len(ids), width)
    return b"".join((MAGIC, header, keys.packed(), ends.packed(), memoryview(ids.astype(f"<u{width}", copy=False))))


class Shard:
    """A shard file's content: ends (Elias-Fano) and ids; doc_id(i) and document(i) read one document."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token-id shard")
        view = memoryview(data)
        self.n, self.unnamed, self.least, tokens, width = HEADER.unpack_from(data, 8)
        self.keys, at = EliasFano.unpack(view, 8 + HEADER.size, self.n - self.unnamed)
        self.ends, at = EliasFano.unpack(view, at, self.n)
        self.ids = np.frombuffer(data, f"<u{width}", tokens, at)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.unnamed else self.least + self.keys.select(i - self.unnamed)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(doc_id, start, end) of every document in order, selected a block at a time."""
        names = (self.least + int(k) for block in self.keys.blocks() for k in block)
        start = 0
        for i, end in enumerate(int(e) for block in self.ends.blocks() for e in block):
            yield None if i < self.unnamed else next(names), start, end
            start = end


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCache(dict):
    """Ids of words as little-endian 32-bit integers; a word not yet seen is encoded by the tokenizer's own model."""

    def __init__(self, model) -> None:
        self.model, self.letters = model, byte_letters()

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():  # of these the space alone has another letter
            found = self.model.tokenize(word.replace(" ", self.letters[32]))
        else:
            found = self.model.tokenize(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters))
        ids = struct.pack(f"<{len(found)}I", *[x.id for x in found])
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class WordEncoder:
    """Ids of whole texts as the tokenizers library encodes them, each distinct word of its pre-tokeniser encoded once.

    Byte-level BPE merges only within the pre-tokeniser's words, so a text's ids are its words' ids in order. The pattern
    is the tokenizer's own. Words are cached up to a fixed number, then the cache starts anew. A text that holds the
    string of an added token goes to the library's encode as it is.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.has_added = regex.compile("|".join(map(regex.escape, added))).search if added else lambda text: None
        self.last_id = max(self.tokenizer.get_vocab().values(), default=0)
        self.find, self.cache = regex.compile(pattern).findall, WordCache(self.tokenizer.model)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.has_added(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.cache.__getitem__, self.find(text)))


def default_tokenizer() -> tuple[str, str]:
    """(path, pre-tokeniser pattern) of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


_encoders: dict[tuple[str, str], WordEncoder] = {}


def encoder(path: str, pattern: str) -> WordEncoder:
    """One encoder a worker: Spark reuses its Python workers, and the cache with them."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = WordEncoder(path, pattern)
    return _encoders[path, pattern]


def _write_once(folder: str, name: str, data: bytes) -> str:
    """The file under its final name, whole or not at all: a repeated task attempt replaces it by equal bytes."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{os.getpid()}-{os.urandom(4).hex()}"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, f"{path}/{name}")
    return f"{folder}/{name}"


def write_shards(docs: DataFrame, folder: str, tokenizer: tuple[str, str] | None = None, end_id: int = 0) -> DataFrame:
    """Writes all of docs to shard files in folder, in ascending doc_id order (null first, ties by a hash of the text, then the text).

    Returns the manifest (file, part, number, documents, tokens): shards in the order of (part, number).
    """
    path, pattern = tokenizer or default_tokenizer()
    manifest_schema = pa.schema({"file": pa.string(), "part": pa.int32(), "number": pa.int32(), "documents": pa.int64(), "tokens": pa.int64()})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, keys, lengths, chunks, size = TaskContext.get().partitionId(), 0, [], [], [], 0
        enc, end = encoder(path, pattern), struct.pack("<I", end_id)
        # ids wait for their file in its own width
        kept = np.dtype("<u2" if max(enc.last_id, end_id) < 1 << 16 else "<u4")

        def close() -> pa.RecordBatch:
            ids = np.concatenate(chunks)
            chunks.clear()
            name = f"shard-{part:06d}-{number:06d}.qtok"
            _write_once(folder, name, encode_shard(keys, lengths, ids))
            return pa.RecordBatch.from_pydict({"file": [name], "part": [part], "number": [number], "documents": [len(keys)], "tokens": [len(ids)]}, manifest_schema)

        for batch in batches:
            # one text at a time becomes a Python string
            for doc_id, none, text in zip(*(batch.column(c) for c in ("doc_id", "none", "text")), strict=True):
                ids = np.frombuffer(enc.encode(text.as_py()) + end, "<u4")
                keys.append(None if none.as_py() else doc_id.as_py())
                lengths.append(len(ids))
                chunks.append(ids.astype(kept))
                size += 2 * len(ids)
                if size >= SHARD_BYTES:
                    yield close()
                    number, keys, lengths, size = number + 1, [], [], 0
        if keys:
            yield close()

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), text_of().alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    # many rows of one id, or without one, are dealt on by text, and equal rows by their place
    dealt = rows.repartitionByRange(n, F.col("none").desc(), "doc_id", "hash", "tie").sortWithinPartitions(F.col("none").desc(), "doc_id", "hash", "text")
    manifest = dealt.select("doc_id", "none", "text").mapInArrow(write, "file string, part int, number int, documents long, tokens long")
    return stored(manifest, "manifest")


def _read(folder: str, name: str) -> bytes:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{path}/{name}") as found:
        return found.read()


def read_shards(folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, file, place.

    Tasks take rows of the manifest and open their files themselves: no file's content is shuffled or joined.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, offset in zip(pdf["file"], pdf["offset"], strict=True):
                shard = Shard(_read(folder, file))
                found = [(d, offset + s, e - s, zlib.crc32(memoryview(shard.ids[s:e].astype("<u4")))) for d, s, e in shard.documents()]
                doc_ids, starts, sizes, crc = zip(*found, strict=True)
                yield pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "start": starts, "n_tokens": sizes, "ids_crc32": crc, "file": file, "place": np.arange(len(found))})

    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    # one row a shard of 32 MB: small beside the ids themselves
    offsets = manifest.select("file", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("offset"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return offsets.repartition(n).mapInPandas(parse, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, place long")


def token_table(docs: DataFrame, tokenizer: tuple[str, str] | None = None, end_id: int = 0) -> DataFrame:
    """docs written to shard files in the shared folder and read back.

    One row per row of docs. Null and empty texts hold the end id only; null doc_ids come first and stay null; repeated rows
    are repeated documents; no rows write no files and give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    manifest = write_shards(docs, folder, tokenizer, end_id)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string, place long")
    return read_shards(folder, manifest)
