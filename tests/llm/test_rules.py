"""Quality rules, line dedup and benchmark search against plain versions."""

import re
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from rankweave.llm import decontaminate, line_dedup, quality_rules
from tests.llm.test_pipeline import bench_words, plain_line_dedup, plain_quality

WORDS = st.lists(st.sampled_from(["a", "b", "The", "é", "x1", "#"]), max_size=60).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(WORDS)
def test_repeated_words(text):
    words = text.split()
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    assert quality_rules.repeated_words(text.encode().split()) == len(covered)


def ledger_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return quality_rules.ledger(docs.withColumn("n_words", docs.doc_id), ["doc_id"])


def test_ledger_policies_and_ablations(spark):
    good = "these are words of a usual text that nobody would throw away for any reason at all ok"
    texts = [good, good, None, "", "short", good.upper(), (good + "\n") * 4, "# " * 30,
             " ".join("# word" for _ in range(3)) + " " + good, "\x1c\xa0 é" + good,
             " ".join(str(i) for i in range(120_000)), "\n".join(["odd line"] * 5 + [good]),
             " ".join(f"{w} {w}" for w in good.split())]
    entries = ledger_of(spark, texts)
    rows = {r["doc_id"]: r for r in entries.withColumn(
        "kept", quality_rules.kept()).collect()}
    for i, text in enumerate(texts):
        assert rows[i]["kept"] == plain_quality(text), text
    assert rows[9]["word_chars"] == len(re.sub("[ \t-\r]", "", texts[9]))
    assert rows[10]["failures"] == quality_rules.BIT["too_many_words"]
    assert [rows[2][c] for c in ("n_words", "word_chars", "n_lines")] == [0, 0, 0]
    found = {r["rule"]: r for r in quality_rules.ablations(entries).collect()}
    bits = [rows[i]["failures"] & quality_rules.mask("v1") for i in rows]
    for name in quality_rules.POLICIES["v1"]:
        bit = quality_rules.BIT[name]
        assert found[name]["n_failed"] == sum(bool(b & bit) for b in bits)
        assert found[name]["n_only"] == sum(b == bit for b in bits)
        assert found[name]["n_rejected"] == sum(b != 0 for b in bits)
    assert ledger_of(spark, []).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab cd e f gggg".split() + ["", "a b", "a b c d"]),
                         max_size=9).map("\n".join), max_size=5), st.integers(1, 6))
def test_windows_cover_every_repeated_run(texts, least):
    """Winnowing keeps a fingerprint of every window, and the chosen runs mark the lines that a
    comparison of all runs marks."""
    marks, runs = line_dedup._winnow(least)()(pa.array(texts, pa.string()))
    first = {}
    for i, (own, found) in enumerate(zip(marks.to_pylist(), runs.to_pylist())):
        assert {r["mark"] for r in found} <= set(own)
        for r in found:
            key, place = (r["r1"], r["r2"]), (i, r["start"])
            first[key] = min(first.get(key, place), place)
    got = []
    for i, (text, found) in enumerate(zip(texts, runs.to_pylist())):
        gone = {k for r in found if first[r["r1"], r["r2"]] < (i, r["start"])
                for k in range(r["start"], r["stop"] + 1)}
        got.append((i, "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)))
    assert got == plain_line_dedup(list(enumerate(texts)), least)


def test_line_dedup_of_a_hot_passage(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    other = "\n".join(" ".join(f"v{i}{k}" for i in range(8)) for k in range(4))
    rows = [(i, f"own {i}\n{passage}\nend {i}") for i in range(40)]
    rows += [(50, other), (51, f"x\n{other}\n\n{other}"), (52, None), (53, ""), (None, passage),
             (50, other), (54, passage + "\n" + passage)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_lines int")
    got = [(r["doc_id"], r["text"], r["n_removed"]) for r in
           line_dedup.remove_repeated_runs(docs).collect()]
    assert (0, rows[0][1], 0) in got
    assert all((i, f"own {i}\nend {i}", 1) in got for i in range(1, 40))
    assert got.count((50, other, 0)) == 2      # a repeated row is the same document
    assert (51, "x\n", 8) in got and (52, None, 0) in got and (53, "", 0) in got
    assert (None, "", 1) in got and (54, "", 2) in got
    assert len(got) == len(rows)
    assert line_dedup.remove_repeated_runs(docs.limit(0)).collect() == []


def plain_find(text, items, size):
    words, hit, found = bench_words(text), set(), set()
    for name, item in items:
        own = bench_words(item)
        n = min(size, len(own))
        for i in range(len(own) - n + 1 if own else 0):
            for k in range(len(words) - n + 1):
                if words[k:k + n] == own[i:i + n]:
                    hit.update(range(k, k + n))
                    found.add(name)
    return len(words), hit, sorted(found)


TEXT = st.lists(st.sampled_from(["a", "B", "c.", "É", "é,d", "-"]), max_size=25).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.lists(TEXT, max_size=4), st.integers(1, 5))
def test_wu_manber_finds_every_occurrence(text, items, size):
    named = [(str(i), x) for i, x in enumerate(items)]
    words = decontaminate.words(text.encode())
    hit, names = set(), set()
    for searcher in decontaminate.searchers([(n, x.encode()) for n, x in named], size):
        for start, window in searcher.search(words):
            hit.update(range(start, start + searcher.length))
            names.update(searcher.names[window])
    assert (len(words), hit, sorted(names)) == plain_find(text, named, size)


@pytest.mark.parametrize("limit", [1 << 26, 60])
def test_benchmark_search_in_one_and_in_many_passes(spark, limit):
    items = [(1, " ".join(f"w{i}" for i in range(14))), (2, "Only Three words"), (3, ""), (4, None),
             (None, "nameless item here"), (2, "Only Three words"), (5, "w2 w3")]
    docs = [(0, "x " + items[0][1] + " y only three WORDS w2 w3"), (1, None), (2, ""), (3, "w2 w4"),
            (4, "nameless, item; here!"), (4, "nameless, item; here!"), (None, "only three words " * 900)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, spans string")
    got = decontaminate.find(frame, ["doc_id"], bench, limit=limit).collect()
    named = [("" if i is None else str(i), x) for i, x in items]
    want = []
    for i, text in docs:
        n, hit, names = plain_find(text, named, 10)
        want.append((str(i), n, sorted(hit), names))
    assert sorted((str(r["doc_id"]), r["n_words"],
                   sorted(k for s in r["spans"] for k in range(s["start"], s["stop"])), r["items"])
                  for r in got) == sorted(want)
    kept = decontaminate.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
    assert decontaminate.find(frame, ["doc_id"], bench.limit(0)).filter("size(items) > 0").count() == 0
    assert decontaminate.find(frame.limit(0), ["doc_id"], bench).collect() == []


def test_names_of_runs_tell_runs_apart():
    hashes = [hash((i * i) % 7) & line_dedup._MASK for i in range(60)]
    for prime, base in zip(line_dedup._PRIMES, line_dedup._BASES):
        assert all(prime % p for p in (2, 3, 5, 7, 11, 13, 17, 19, 23)) and 0 < base < prime
        assert pow(3, prime - 1, prime) == 1 and pow(7, prime - 1, prime) == 1
        name = line_dedup.run_names(hashes, prime, base)
        seen = {}
        for first in range(60):
            for last in range(first, 60):
                seen.setdefault(name(first, last), set()).add(tuple(hashes[first:last + 1]))
        assert all(len(runs) == 1 for runs in seen.values())
        assert len(seen) == len({r for runs in seen.values() for r in runs})


def test_line_dedup_is_linear_in_lines_without_words():
    words = " ".join(f"w{i}" for i in range(25))
    winnow = line_dedup._winnow(20)()

    def seconds(n):
        start = time.perf_counter()
        winnow(pa.array([words + "\n" * n + words]))
        return time.perf_counter() - start

    seconds(1000)
    # A million lines take some seconds; with a cost by run length they would take half an hour.
    assert seconds(1_000_000) < 60
    spans = [[{"start": i, "stop": 99_999} for i in range(0, 100_000, 2)]]
    start = time.perf_counter()
    kept, lines, gone = line_dedup._remove(pa.array(["x\n" * 100_000]), pa.array(spans))
    assert time.perf_counter() - start < 10
    assert (kept.to_pylist(), lines.to_pylist(), gone.to_pylist()) == ([""], [100_001], [100_000])
