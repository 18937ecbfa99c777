"""Operator 6: round trips of the format, and ids against the library on whole texts."""

import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillet.llm import tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700), st.integers(0, 4))
def test_elias_fano_round_trip(lengths, scale):
    ends = np.cumsum(np.array(lengths, np.int64) * 37**scale)
    ef = tokens.EliasFano.encode(ends)
    again, behind = tokens.EliasFano.unpack(memoryview(b"xx" + ef.packed() + b"yy"), 2, len(ends))
    assert behind == 2 + len(ef.packed()) and [int(x) for b in again.blocks() for x in b] == ends.tolist()
    assert [again.select(i) for i in range(0, len(ends), 7)] == ends.tolist()[::7]
    with pytest.raises(IndexError):
        again.select(len(ends))


def test_space_is_near_the_bound():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 4000, 20_000))
    ef = tokens.EliasFano.encode(ends)
    assert 8 * len(ef.packed()) <= len(ends) * (3 + np.log2(ends[-1] / len(ends)))
    # a whole file: boundaries and doc ids take a few bytes a document beside its ids
    ids = np.zeros(int(ends[-1]), np.uint16)
    data = tokens.encode_shard([7 * i for i in range(20_000)], np.diff(ends, prepend=0).tolist(), ids)
    assert len(data) - ids.nbytes < 3 * len(ends)


def test_shard_round_trip():
    lengths, rng = [3, 1, 0, 5, 2, 4], np.random.default_rng(2)
    names = [None, None, -(1 << 63), 7, 7, (1 << 63) - 1]
    for top in (50_000, 90_000):
        ids = rng.integers(0, top, 15).astype(np.uint32)
        shard = tokens.Shard(tokens.encode_shard(names, lengths, ids))
        assert [shard.doc_id(i) for i in range(6)] == names and shard.ids.tolist() == ids.tolist()
        assert [len(shard.document(i)) for i in range(6)] == lengths
        assert [(d, e - s) for d, s, e in shard.documents()] == list(zip(names, lengths, strict=True))
    with pytest.raises(ValueError):
        tokens.Shard(b"something else")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer()[0])


def tie(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute(rows):
    """The library's tokenizer as it comes."""
    t, at, out = library(), 0, []
    for d, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0], tie(r[1]))):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return sorted(out, key=repr)


def test_token_table(spark, docs, sf_docs, odd, odd_rows, none, monkeypatch):
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, tokens.token_table(docs).select(*names).collect()), key=repr) == brute([(d["doc_id"], d["text"]) for d in sf_docs])
    monkeypatch.setattr(tokens, "SHARD_BYTES", 4000)
    assert sorted(map(tuple, tokens.token_table(odd).select(*names).collect()), key=repr) == brute(odd_rows)
    assert tokens.token_table(none).count() == 0
    # many rows without an id, of one id and equal ones
    rows = [(None, f"text {i}") for i in range(300)] + [(5, f"other {i % 200}") for i in range(300)] + [(6, "a <|endoftext|> b")] * 3
    many = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, tokens.token_table(many).select(*names).collect()), key=repr) == brute(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "\r\n", "'s", "'LL", " don't", "12345", "\u00a0", "é\u0301", "\U0001f600", "\u200b", "ſ", "\x00", "中文"])), max_size=12))
def test_ids_are_the_librarys(parts):
    """Whatever the text, added tokens' strings included: the word cache gives the ids of the library's own encode."""
    text = "".join(parts).encode("utf-8", "ignore").decode()
    enc = tokens.encoder(*tokens.default_tokenizer())
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    enc = tokens.WordEncoder(*tokens.default_tokenizer())
    text = "It's  a <|endoftext|> test\r\n\r\n of  12345 things' — naïve \U0001f600 "
    for t in (text, "a b c d e f g h", ""):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids
