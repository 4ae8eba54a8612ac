"""Ids and decoded texts against the tokenizers library, text by text."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from rankweave.llm import bpe, chunks, token_files
from rankweave.llm.common import text_bytes

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
SHARED = "the quick brown fox jumps over the lazy dog, again and again; " * 12
TEXTS = [
    None, "", " \n\t ", "a", "Hello, World!", "it's We'LL '' x's'", "<|endoftext|> <|ENDOFTEXT|>a",
    "a<|startoftext|>b c", "é ́a J̌ ǰ ẞ ΣΣ İI", "x" * 5000,
    "café naïve. Été, À! ß ça", "1234 5a6 ½ ٣",
    "\x85nel\x85 a\xa0b c \x1c\x1d", "你好世界 " * 300, "\U0001f600‍!?" * 50, "a\x00b",
    SHARED, "one " + SHARED + "two", "three" + SHARED, "tail\n", "\nhead", "A " * 4000,
]


def wanted(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def by_chunks(store, texts):
    return store.encode(chunks.cut(*text_bytes(pa.array(texts, pa.string()))))


def test_chunked_ids_and_texts_equal_the_library(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs = docs.withColumn("ids", docs.doc_id)  # a column of the same name is not taken
    done = chunks.encode_decode(docs.union(docs), ["doc_id"], PATH).collect()
    assert len(done) == 2 * len(TEXTS)
    assert chunks.encode_decode(docs.limit(0), ["doc_id"], PATH).collect() == []
    for row in done:
        ids, text = wanted(TEXTS[row["doc_id"]])
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids
        assert (row["n_tokens"], row["decoded"]) == (len(ids), text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(
    st.text(max_size=300),
    st.text("aAbB'<|>,. \néÉ́Σendoftext", max_size=400),
    st.lists(st.sampled_from(["the", "The,", "re-", "'s", " ", "\n", "été", "<|endoftext|>", "x1"]),
             max_size=150).map("".join)), max_size=6))
def test_any_texts_equal_the_library(texts):
    ids, spelled = by_chunks(chunks.ChunkStore(PATH, kept=20), texts)
    assert [(np.frombuffer(a, "<u4").tolist(), b.decode()) for a, b in zip(ids, spelled)] == \
        [wanted(t) for t in texts]


def test_shared_passages_fall_into_shared_chunks():
    passage = " ".join(str(i * i) for i in range(500))
    first, second = chunks.cut(*text_bytes(pa.array(
        ["one " + passage + " end", "quite another beginning " + passage + "!"])))
    assert len(set(first) & set(second)) > 2


@pytest.mark.parametrize("n", [0, 1, 2])
def test_token_files_give_back_every_id(spark, tmp_path, n):
    rows = [(i, t) for i, t in enumerate(TEXTS)] * n + [(None, "no id")] * n
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "ids")
    token_files.write_token_files(docs, path, PATH)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"])
                 for r in token_files.document_digests(spark, path).collect())
    want, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*wanted(text)[0], 2]
        want.append((at, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_a_reader_of_one_document_hands_its_id_to_the_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, "text") for i in range(100)], "doc_id long, text string")
    path = str(tmp_path / "ids")
    token_files.write_token_files(docs, path, PATH)
    found = token_files.read_token_files(spark, path).filter("doc_id = 42")
    assert "EqualTo(doc_id,42)" in found._jdf.queryExecution().executedPlan().toString()
    assert [len(r["ids"]) for r in found.collect()] == [2]


def test_a_full_store_keeps_the_newer_half():
    store = chunks.ChunkStore(PATH, kept=4)
    for chunk in (b"a 1 x", b"b 2 x", b"c 3 x", b"d 4 x", b"e 5 x"):
        store.learn({chunk})
    assert list(store.chunks) == [b"c 3 x", b"d 4 x", b"e 5 x"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["word", "Ünï", "12", "'s", "<|endoftext|>", ".", "，", "你好", "é",
                                 "e\u0301", "<\u0338", " ", "\n", "-", "_", "½", "a1b", "?!"]),
                max_size=120).map("".join), st.integers(4, 60))
def test_windows_of_a_long_text_have_its_ids(text, size):
    parts = bpe.windows(text.encode(), size)
    assert b"".join(parts) == text.encode()
    assert [i for p in parts for i in wanted(p.decode())[0]] == wanted(text)[0]


@pytest.mark.parametrize("text", ["Some words, 12 of them. " * 870_000, "1ab-cd.ef" * 2_300_000],
                         ids=["words", "no white space"])
def test_a_text_of_20_mb_is_encoded_in_windows(text):
    table = bpe.pieces(PATH)
    ids = np.frombuffer(table.encode([text.encode()])[0][0], "<u4")
    n = 24 if text[0] == "S" else 9
    one = wanted(text[:100 * n])[0]
    assert len(ids) == len(one) * (len(text) // (100 * n))
    assert ids[:len(one)].tolist() == one


def test_rows_of_one_id_lie_in_several_parts(spark, tmp_path):
    docs = spark.range(4000).selectExpr("7L AS doc_id", "'the same text' AS text")
    path = str(tmp_path / "ids")
    token_files.write_token_files(docs, path, PATH)
    rows = token_files.read_token_files(spark, path).groupBy("part").count().collect()
    assert len(rows) > 1 and max(r["count"] for r in rows) < 3000
    assert token_files.document_digests(spark, path).select("start").distinct().count() == 4000
