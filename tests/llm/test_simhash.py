"""Fingerprints, links and components against all pairs."""

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from rankweave.llm import simhash


def plain_fingerprint(text, size=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\r\x0b\x0c":
        lowered = lowered.replace(space, " ")
    words = [w for w in lowered.split(" ") if w]
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or (
        [" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """{fingerprint: least member's position} by search over all pairs."""
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f
    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= 3:
                root[top(a)] = top(b)
    return {f: top(f) for f in fps}


@settings(max_examples=100, deadline=None)
@given(st.text("aB cÉ\n\t\x1c\xa0 xyz", max_size=200))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def noisy(rng, n, centers, flips):
    base = rng.integers(0, 1 << 63, centers, dtype=np.uint64)
    found = base[rng.integers(0, centers, n)]
    for _ in range(flips):
        found = found ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return found


@pytest.mark.parametrize("n, centers, flips", [(1, 1, 0), (70, 1, 2), (400, 5, 3), (300, 100, 4)])
def test_bucket_links_connect_what_is_near(n, centers, flips):
    rng = np.random.default_rng(n)
    fps = np.unique(noisy(rng, n, centers, flips))
    bucket = np.sort(rng.integers(0, 3, len(fps)))
    a, b = simhash.bucket_links(bucket, fps)
    root = {}
    for k in range(3):
        own = fps[bucket == k].tolist()
        top = plain_components(own)
        groups = {f: min(x for x in own if top[x] == top[f]) for f in own}
        root |= groups
    linked = dict(zip(a.tolist(), b.tolist()))
    assert {f: linked.get(f, f) for f in fps.tolist()} == root


def test_a_pair_within_the_radius_agrees_on_a_mask():
    rng = np.random.default_rng(1)
    deep = [simhash.masks(m, 2) for m in simhash.masks()]
    assert {bin(m).count("1") for m in simhash.masks()} == {28}
    for _ in range(300):
        difference = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not difference & m for m in simhash.masks())
        for m, more in zip(simhash.masks(), deep):
            assert bool(difference & m) or any(not difference & d for d in more)


@pytest.mark.parametrize("limit", [4096, 5])
def test_components_of_links(spark, limit):
    rng = np.random.default_rng(7)
    fps = np.unique(noisy(rng, 600, 12, 4))
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    found = simhash.components(simhash.links(frame, limit)).collect()
    want = plain_components(fps.tolist())
    unsigned = lambda x: x % (1 << 64)
    got = {unsigned(r["node"]): unsigned(r["root"]) for r in found}
    groups = {}
    for f in fps.tolist():
        groups.setdefault(want[f], []).append(f)
    for members in groups.values():
        tops = {got.get(f, f) for f in members}
        assert len(tops) == 1 and tops <= set(members)
    assert len({got.get(f, f) for f in fps.tolist()}) == len(groups)


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    found = simhash.components(edges).collect()
    assert len(found) == 301 and {r["root"] for r in found} == {0}
    assert simhash.components(edges.limit(0)).count() == 0


def test_edge_cases_and_one_of_each(spark):
    long_text = " ".join(str(i) for i in range(5000))
    rows = [(3, "a b c d e"), (1, "A  b\tC d e"), (None, "a b c d e"), (5, None), (4, ""),
            (4, ""), (7, long_text), (8, long_text + " x"), (None, "quite alone here"), (9, "q")]
    docs = spark.createDataFrame([(*r, "fp") for r in rows], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {(r["doc_id"], r["fp"] % (1 << 64)) for r in got}
    assert fps == {(i, plain_fingerprint(t)) for i, t in rows}
    ids = sorted(((r["doc_id"], r["component_id"]) for r in got), key=str)
    assert ids == sorted([(3, 1), (1, 1), (None, 1), (5, 4), (4, 4), (4, 4), (7, 7), (8, 7),
                          (None, None), (9, 9)], key=str)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [
        (0, "quite alone here"), (1, "A  b\tC d e"), (4, ""), (7, long_text), (9, "q")]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    assert simhash.one_of_each(docs.limit(0)).collect() == []
