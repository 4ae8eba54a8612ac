"""Ids of the byte-level file against the tokenizers library, text by text."""

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from rankweave.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TABLE = byte_bpe.Encoder(PATH)


def wanted(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def got(texts, end_id=None):
    ids, ends = TABLE.encode(pa.array(texts, pa.string()), end_id)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


TEXTS = ["", " ", "\n", "a", "Hello, World! it's We'LL  two  spaces \n\n x\t\ty", "'s'S 'll'd",
         "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "café naïve × ÷ ½ ٣ ２",
         "\x85nel\x85 a\xa0b c \x1c\x1d \x00 \x7f", "你好 世界 。", " x 　 y",
         "\U0001f600 ‍!? é", "x" * 3000, "it’s — here… “so”"]


def test_odd_texts_equal_the_library():
    assert got(TEXTS) == [wanted(t) for t in TEXTS]
    assert got(TEXTS, 1) == [[*wanted(t), 1] for t in TEXTS]
    assert got([]) == []


@settings(max_examples=250, deadline=None)
@given(st.lists(st.one_of(
    st.text(max_size=200),
    st.text("aAbZ'stlm09 \n\t.,!é×\xa0\x1c\x85—’", max_size=300),
    st.lists(st.sampled_from(["the", " The", "'s", " 's", "  ", "\n\n", " \n", "été", " 12", "x1",
                              "<|endoftext|>", "—", " —", "\t", "你", "."]),
             max_size=100).map("".join)), max_size=5))
def test_any_texts_equal_the_library(texts):
    assert got(texts) == [wanted(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", " word", "Ünï", "12", "'s", ".", " ", "  ", "\n", "é", "-",
                                 " 你好", "'", "!?", "a1b"]), max_size=120).map("".join),
       st.integers(4, 60))
def test_windows_of_a_long_text_have_its_ids(text, size):
    parts = byte_bpe.windows(text, size)
    assert "".join(parts) == text
    assert [i for p in parts for i in wanted(p)] == wanted(text)


def test_another_kind_of_file_is_refused():
    with pytest.raises(ValueError):
        byte_bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))


def test_every_code_point_equals_the_library():
    for start in range(0, 0x110000, 1 << 16):
        texts = [f"a{c}1{c} {c}b  {c}{c}!{c}\n{c}" for c in map(chr, range(start, start + (1 << 16)))
                 if not 0xD800 <= ord(c) < 0xE000]
        ids, ends = TABLE.encode(pa.array(texts))
        want = LIBRARY.encode_batch_fast(texts, add_special_tokens=False)
        assert ids.tolist() == [i for e in want for i in e.ids]


@pytest.mark.parametrize("text", ["\n" * 300_000, " " * 300_000, "a" * 300_000, "?" * 300_000])
def test_long_runs_equal_the_library(text):
    assert got([text + "x"]) == [wanted(text + "x")]


@pytest.mark.parametrize("text", ["Some words, 12 of them." * 900_000, "many words " * 2_000_000],
                         ids=["no white space", "words"])
def test_a_text_of_20_mb(text):
    unit = 23 if text[0] == "S" else 11
    ids, ends = byte_bpe.Encoder(PATH).encode(pa.array([text]))
    one = wanted(text[:100 * unit])
    assert ids[:len(one) - 5].tolist() == one[:-5]
    assert abs(len(ids) / len(text) - len(one) / (100 * unit)) < 0.01
