"""Token counts and BPE against the libraries themselves."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerline.llm import bpe, tokencount
from ledgerline.llm.workers import Cache

BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "\n", " a", "a ", "  a  b ", "a\nb", "a\n\nb", "\n a", " \n a", "a\r\n b", "don't  I'll", "é ½ Ⅷ ﬁ", "a　b\x85c\x1cd", "▁a ▁▁ b", "\x00y"]
ODD += ["<|endoftext|>a <|endoftext|>  <|endoftext|>", "</s> <s>x <unk>", "🙂🙂 中文中文", "a" * 50, "ab" * 30, "the" * 4000, "x y " * 20_000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE_FILE)


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(bpe.read_vocabulary(BPE_FILE))


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)


@pytest.fixture(scope="module")
def counter():
    return tokencount.TokenCounter(tokencount.read_model(PIECE_FILE), {})


def same(library, encoder, text):
    ids = library.encode(text, add_special_tokens=False).ids
    packed = encoder.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == ids
    assert encoder.decode(packed) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_encoder_on_odd_texts(library, encoder, text):
    same(library, encoder, text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=" \n\t abtheinrg's1½é中🙂.,!\x1c\x85　", max_size=60))
def test_encoder_equals_library(library, encoder, text):
    same(library, encoder, text)


def test_every_pair_that_fits_is_what_the_merges_leave(library, encoder):
    draw = random.Random(3)
    ids = [i for i, word in enumerate(encoder.words) if word.isascii() and word.isalpha()]
    for _ in range(2000):
        a, b = draw.choice(ids), draw.choice(ids)
        merged = library.encode(encoder.words[a] + encoder.words[b], add_special_tokens=False).ids
        assert encoder.fits[a, b] == (merged == [a, b])


def test_invalid_bytes_are_replaced(library, encoder):
    ids = library.encode("é🙂", add_special_tokens=False).ids[:1]
    assert encoder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_counts_on_odd_texts(pieces, counter, text):
    assert counter.count(text) == len(pieces.encode(text))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=" \n\tabtheinrg▁1½é中.,\x00　", max_size=60))
def test_counts_equal_library(pieces, counter, text):
    assert counter.count(text) == len(pieces.encode(text))


def test_counts_without_exact_cuts_take_whole_texts(pieces, monkeypatch):
    monkeypatch.setattr(tokencount, "cuts_are_exact", lambda model: False)
    plain = tokencount.TokenCounter(tokencount.read_model(PIECE_FILE), {})
    assert plain.count("a  b\nc") == len(pieces.encode("a  b\nc"))


def test_cache_stays_bounded_and_right():
    cache = Cache(lambda key: key.upper(), 3, longest=4, fixed={"x": "fixed"})
    assert [cache[c] for c in "abcdabcdx"] == list("ABCDABCD") + ["fixed"]
    assert cache["longer"] == "LONGER" and "longer" not in cache
    assert len(cache) <= 3 and len(cache.old) <= 3


def test_operators_on_a_table(documents, pieces, library):
    texts = [*ODD, None, "same words here", "same words here"]
    docs = documents([(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (0, texts[0])])
    counts = tokencount.count_tokens(docs, PIECE_FILE).collect()
    assert len(counts) == len(texts) + 2
    for row in counts:
        text = "null id" if row.doc_id is None else texts[row.doc_id] or ""
        assert (row.n_bytes, row.n_tokens) == (len(text.encode()), len(pieces.encode(text)))
    done = bpe.round_trip(docs, BPE_FILE).collect()
    assert len(done) == len(texts) + 2
    for row in done:
        text = "null id" if row.doc_id is None else texts[row.doc_id] or ""
        assert np.frombuffer(row.ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert row.n_tokens * 4 == len(row.ids) and row.decoded == text


def test_empty_table(documents):
    none = documents([])
    assert tokencount.count_tokens(none, PIECE_FILE).count() == 0
    assert bpe.round_trip(none, BPE_FILE).count() == 0


def test_query_digests(spark, documents, tmp_path):
    from ledgerline.llm import queries

    documents([(1, "Hello there"), (2, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in queries.QUERIES["op9_bpe_round_trip"](spark, str(tmp_path)).collect()}
    assert rows[1].decoded_sha256 == hashlib.sha256(b"Hello there").hexdigest()
    assert rows[2].n_tokens == 0 and rows[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    limits = {r.doc_id: r.over_limit for r in queries.QUERIES["op1_token_counts"](spark, str(tmp_path)).collect()}
    assert limits == {1: False, 2: False}


def test_usual_texts_are_split_alike():
    draw = random.Random(4)
    letters = [chr(c) for c in [*range(0x20, 0x7F), *range(0xC0, 0xD7), *range(0xF8, 0x100)]] + list("  \n\t\r''sdtrevml  \n")
    for _ in range(4000):
        text = "".join(draw.choices(letters, k=draw.randint(0, 40)))
        assert bpe.USUAL.fullmatch(text) and bpe.USUAL_SPLIT.findall(text) == bpe.SPLIT.findall(text)


def test_outputs_of_the_round_trip(spark, documents):
    rows = documents([(1, "Hello there"), (2, None)])
    names = ["decoded_sha256", "ids_sha256", "ids", "decoded", "n_tokens"]
    found = bpe.round_trip(rows, BPE_FILE, outputs=names)
    assert found.columns == ["doc_id", *names]
    for r in found.collect():
        assert r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
