"""Packing: the round-robin token by token, exact round trips, proportions of every sequence."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankweave.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def served(totals, rates):
    """The queue of every token by a plain loop: the one whose next token is due first."""
    given, order = [0] * len(totals), []
    while sum(given) < sum(totals):
        queue = min((q for q, n in enumerate(totals) if given[q] < n),
                    key=lambda q: ((given[q] + 0.5) / rates[q], q))
        given[queue] += 1
        order.append(queue)
    return order


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 50)), min_size=1, max_size=6),
       st.booleans(), st.integers(1, 20))
def test_given_tokens_equal_a_plain_loop(queues, own, length):
    totals = [n for n, _ in queues]
    rates = [float(n) for n in totals] if own else [float(r) for _, r in queues]
    if not sum(totals):
        return
    schedule = packing.Schedule(totals, None if own else rates, length)
    order = served(totals, [r or 1.0 for r in rates])
    at = np.arange(len(order) + 1)
    want = np.array([[order[:i].count(q) for q in range(len(totals))] for i in at])
    assert (schedule.given(at) == want).all()
    if own:
        assert np.abs(schedule.deficits(at)).max() < max(2, len(totals))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 40), max_size=8), min_size=1, max_size=5),
       st.integers(4, 32))
def test_pieces_fill_every_sequence_without_gaps(queues, length):
    totals = [sum(q) for q in queues]
    schedule = packing.Schedule(totals, None, length)
    filled = {}
    for q, sizes in enumerate(queues):
        if not sizes:
            continue
        first = np.cumsum([0, *sizes[:-1]])
        # In two runs, as two tasks would.
        half = len(sizes) // 2
        for rows in (slice(0, half), slice(half, None)):
            if not len(first[rows]):
                continue
            size = np.array(sizes)[rows]
            got = [x.tolist() for x in schedule.pieces(q, first[rows], size)]
            seen = [0] * len(size)
            for doc, start, n, sequence, offset in zip(*got):
                assert start == seen[doc] and n > 0
                seen[doc] += n
                filled.setdefault(sequence, []).append((offset, n))
            assert seen == size.tolist()
    for sequence in range(schedule.sequences):
        at = 0
        for offset, n in sorted(filled.pop(sequence)):
            assert offset == at
            at += n
        assert at == length or (sequence >= schedule.full and at & (at - 1) == 0 and at < length)
    assert not filled


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, offset string")


def documents():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        rows.append((i, " ".join(f"word{x}" for x in rng.integers(0, 99, rng.integers(1, 80))),
                     source, "x"))
    rows += [(900, None, "a", None), (901, "", None, None), (None, "no id", "b", None),
             (903, "long text, " * 30_000, "b", None), (5, "again", "hot", "x"),
             (5, "again", "hot", "x"), (904, "tiny source", "c", "x")]
    return rows


@pytest.mark.parametrize("target", [None, {"hot": 1.0, "a": 2.0}])
def test_every_id_lies_in_one_piece(spark, target):
    rows = documents()
    docs = frame(spark, rows).repartition(5)
    pieces = packing.pack(docs, PATH, target=target, length=64, with_ids=True)
    found = pieces.collect()
    by_doc = {}
    for r in found:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["length"] == len(r["ids"])
        by_doc.setdefault(r["doc_id"], []).append(r)
    want = {}
    for i, text, _, _ in rows:
        want.setdefault(i, []).append(
            [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1])
    assert set(by_doc) == set(want)
    for i, lists in want.items():
        # Rows of one id come one after the other in their pieces' starts.
        got = sorted(by_doc[i], key=lambda r: (r["start"], r["sequence_id"]))
        assert sum(r["length"] for r in got) == sum(map(len, lists))
        if len(lists) == 1:
            assert [x for r in got for x in r["ids"]] == lists[0]
            assert {r["doc_tokens"] for r in got} == {len(lists[0])}
    total = sum(len(x) for lists in want.values() for x in lists)
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(pieces, 64).collect()}
    assert sorted(whole) == list(range(len(whole)))
    for k, ids in whole.items():
        assert len(ids) == 64 or (k >= total // 64 and len(ids) & (len(ids) - 1) == 0)
    if target is None:
        shares = {}
        for r in found:
            shares.setdefault(r["queue"], {}).setdefault(r["sequence_id"], 0)
            shares[r["queue"]][r["sequence_id"]] += r["length"]
        for got in shares.values():
            share = sum(got.values()) / total
            for k in range(total // 64):
                assert abs(got.get(k, 0) - 64 * share) < 3


def test_empty_table_and_common_queue(spark):
    assert packing.pack(frame(spark, []), PATH).collect() == []
    rows = [(i, "some text here", f"site {i}", "x") for i in range(400)]
    found = packing.pack(frame(spark, rows), PATH).agg(
        F.countDistinct("queue").alias("n"), F.sum("length").alias("size")).first()
    assert (found["n"], found["size"]) == (1, 400 * 4)
