import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stepwell.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pair():
    return bpe.codec_of(bpe.read_vocabulary(PATH)), Tokenizer.from_file(PATH)


def same(pair, text):
    codec, tokenizer = pair
    ids = codec.encode(text)
    assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids).decode() == tokenizer.decode(ids.tolist(), skip_special_tokens=False)


CASES = ["", " ", "a", "  a  b\n\n\tc ", "it's we'll I'M", "<|endoftext|>", "a<|endoftext|> b<|endo", "x" * 5000, "ab" * 3000, " \x1c\x1f\x85\xa0 ​　x", "½²Ⅷ٣ ı ſ 'ſ", "日本語テキスト 🙂‍↔️ é é", "\r\n \r\n", "aaaa aaaaa aaaaaaaaaa", "....!!!??? ===== _____", " lead", "trail ", "a\n b", "a \nb c", "\xa0 a b\u3000 c d", "one two's three\x1c four", "x  y z"]


@pytest.mark.parametrize("text", CASES)
def test_cases(pair, text):
    same(pair, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(pair, text):
    same(pair, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abeinorst'  1\n.<|>é\xa0", max_size=120))
def test_dense_text(pair, text):
    same(pair, text)


def test_every_entry_encodes_to_itself(pair):
    codec, _ = pair
    wrong = [i for i, e in enumerate(codec.entries) if i < 50256 and codec.encode_piece(e) != [i]]
    assert not wrong


def test_slices(pair, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 50)
    same(pair, "The and attion to thanedble the, anea.  Eriner\n\n thanea é " * 40)


def test_specials_as_text(pair):
    codec = bpe.codec_of(bpe.read_vocabulary(PATH), True)
    assert 50256 not in codec.encode("a<|endoftext|>b").tolist()
    assert codec.decode(codec.encode("a<|endoftext|>b")) == b"a<|endoftext|>b"


def test_library_pieces(pair):
    fast = bpe.codec_of(bpe.read_vocabulary(PATH), library=True)
    for text in CASES:
        assert fast.encode(text).tolist() == pair[0].encode(text).tolist()


def test_frame(spark, pair):
    rows = [(1, "Hello wörld", "x"), (2, None, "y"), (3, "", None), (None, "Hello wörld", "x"), (1, "Hello wörld", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.digests(bpe.encode_documents(docs, PATH)).collect()
    assert len(got) == 5
    for r, (i, text, _) in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.n_tokens)), sorted(rows, key=lambda r: (r[0] or 0, len(r[1] or ""))), strict=True):
        ids = np.array(pair[1].encode(text or "", add_special_tokens=False).ids, "<u4")
        assert (r.doc_id, r.n_tokens, r.ids_sha256) == (i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(bpe.encode_documents(docs.limit(0), PATH)).count() == 0
