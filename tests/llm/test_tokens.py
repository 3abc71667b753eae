import hashlib
import struct

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from graphlens.llm import piece_codec, token_counts
from graphlens.llm.shared import shared_path
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "\n\n a", "▁", "a▁b", "▁ ▁", "\0", "a\0b", "日本語 テスト", "😀 x", "\t\ta  \n  b", "<s> </s> <unk>", "<0x0A>", " \n ", "x" * 5000, "\r\nabc\r\n"]


def encoded(codec, texts):
    ids, starts, ends, at = codec.encode(pa.array(texts, pa.large_string()))
    cut = lambda x: [x[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    return cut(ids), cut(starts), cut(ends), codec.decode(ids, at), codec.decimals(ids, at)


def check(codec, library, texts):
    ids, starts, ends, decoded, decimals = encoded(codec, texts)
    for text, i, s, e, d, c in zip(texts, ids, starts, ends, decoded, decimals, strict=True):
        assert i == library.encode(text)
        assert d == library.decode(i)
        assert c.decode() == ",".join(map(str, i))
        if text:  # spans follow each other and cover the text
            assert s[0] == 0 and e[-1] == len(text.encode()) and s[1:] == e[:-1]
        normalised, source = codec.normalizer.normalise(text)
        assert source[np.cumsum(codec.sizes[i])].tolist() == e if i else not text


@pytest.fixture(scope="module")
def codec(piece_model):
    return piece_codec.Codec(piece_model)


@pytest.fixture(scope="module")
def library(piece_model):
    return sentencepiece.SentencePieceProcessor(model_file=piece_model)


def test_codec_is_the_librarys(codec, library):
    check(codec, library, TEXTS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n▁é日\0.x\t"), max_size=30), min_size=1, max_size=5))
def test_codec_on_any_text(codec, library, texts):
    check(codec, library, texts)


def double_array(entries):
    """A small compiled character map: byte keys to replacements, as a double array."""
    strings, at = b"", {}
    for key, value in entries.items():
        at[key] = len(strings)
        strings += value + b"\0"
    units = {0: None}
    free = [256]

    def place(prefix, position):
        own = {k: v for k, v in at.items() if k.startswith(prefix)}
        nexts = sorted({k[len(prefix)] for k in own if len(k) > len(prefix)})
        base = free[0]
        free[0] += 256
        unit = (position ^ base) << 10
        label = prefix[-1] if prefix else 0
        if prefix in at:
            unit |= 0x100
            units[base] = 0x80000000 | at[prefix]
        units[position] = unit | label
        for byte in nexts:
            place(prefix + bytes([byte]), base ^ byte)

    place(b"", 0)
    table = [units.get(i) or 0xFF for i in range(max(units) + 256)]
    blob = struct.pack(f"<{len(table)}I", *table)
    return struct.pack("<I", len(blob)) + blob + strings


def test_longest_prefix_of_the_character_map(codec):
    marks = piece_codec.CharacterMap(double_array({"ﬁ".encode(): b"fi", "e\u0301".encode(): "é".encode(), b"e": b"E", "\u3000".encode(): b" "}))
    assert marks.longest("ﬁx".encode(), 0) == (3, b"fi")
    assert marks.longest("e\u0301".encode(), 0) == (3, "é".encode())
    assert marks.longest(b"ex", 0) == (1, b"E")
    assert marks.longest(b"x", 0) is None

    class Model:
        map, user, dummy, squeeze, escape = marks, [], True, True, True

    normalised, source = piece_codec.Normalizer(Model()).normalise("  aﬁ\u3000 e\u0301 ")
    assert normalised == "▁afi▁é"
    assert source.tolist() == [2, 2, 2, 2, 3, 3, 6, 6, 6, 10, 10, 13]


def test_encode_and_decode_tables(spark, odd_docs, no_docs, library, piece_model):
    rows = piece_codec.decode(piece_codec.encode(odd_docs, piece_model), piece_model).collect()
    assert len(rows) == odd_docs.count() and rows[0].asDict().keys() == {*odd_docs.columns, "ids", "starts", "ends", "decoded"}
    for r in rows:
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
    assert piece_codec.encode(no_docs, piece_model).count() == piece_codec.round_trip(no_docs, piece_model).count() == 0
    for r in piece_codec.round_trip(odd_docs, piece_model).collect():
        ids = library.encode(r.text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest() and r.covered_bytes == len((r.text or "").encode())


def test_counts_are_the_librarys(word_model):
    counter, library = token_counts.Counter(word_model), Tokenizer.from_file(word_model)
    assert counter.by_word
    texts = [*TEXTS, "It's <|endoftext|> x", "A<|startoftext|>b", "e\u0301 Éé ΣΑΣ", "1234 5,6"]
    assert counter.count(pa.array(texts, pa.large_string())).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_digest_cache(spark, odd_docs, no_docs, word_model, piece_model, library):
    cache = shared_path(spark, "test-cache")
    rows = token_counts.count_tokens(odd_docs, word_model, cache=cache, limit=100).collect()
    assert len(rows) == odd_docs.count()
    whole = Tokenizer.from_file(word_model)
    for r in rows:
        n = len(whole.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 100)
    first = spark.read.parquet(cache).count()
    assert first == 5  # blank texts, and texts that differ in white space alone, share an entry
    token_counts.count_tokens(odd_docs, word_model, cache=cache).collect()
    assert spark.read.parquet(cache).count() == first  # nothing missed
    assert token_counts.count_tokens(odd_docs, piece_model, cache=cache).filter("doc_id = 4").first().n_tokens == len(library.encode("Plain words of a text."))
    assert spark.read.parquet(cache).select("tokenizer_digest").distinct().count() == 2
    assert token_counts.count_tokens(no_docs, word_model).count() == 0
