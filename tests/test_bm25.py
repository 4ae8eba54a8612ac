import math
import pickle
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows
from rankweave.functions.text import ascii_words
from rankweave.operators import bm25, legacy
from rankweave.sources import index

# The smoke corpus and the urls its queries are expected to find first.
SMOKE = {
    "python-bm25-exact": "python bm25 retrieval ranking search guide",
    "python-retrieval-heavy": "python retrieval retrieval retrieval retrieval bm25 search system "
                              "latency throughput indexing evaluation monitoring operations",
    "bm25-length-normalization": "bm25 ranking formula idf document length normalization saturation",
    "dense-retrieval": "dense retrieval vector embedding semantic search neural reranking",
    "python-data-analysis": "python data analysis dataframe notebook tutorial",
    "italian-pasta": "italian pasta tomato basil olive oil recipe kitchen",
    "marathon-running": "marathon running training weekly pacing endurance race plan",
    "long-noisy-python-bm25": "python bm25 retrieval observability pipeline service deployment "
                              "incident capacity planning metrics alerting dashboard storage "
                              "compute scheduler orchestration reliability backlog maintenance",
}
EXPECTED = {
    "python bm25 retrieval": ["python-bm25-exact", "python-retrieval-heavy"],
    "retrieval retrieval retrieval": ["python-retrieval-heavy"],
    "dense retrieval semantic search": ["dense-retrieval"],
    "italian pasta basil": ["italian-pasta"],
    "bm25 length normalization": ["bm25-length-normalization"],
}
# The tutorial corpus.
TUTORIAL = {
    1: "Python programming for data science and machine learning.",
    2: "A practical guide to cooking Italian pasta with tomato and basil.",
    3: "Advanced ranking models for search and information retrieval.",
    4: "How to train for a marathon with weekly running plans.",
    5: "Building retrieval systems using BM25 and vector embeddings.",
    6: "Data engineering pipelines for reliable analytics and reporting.",
    7: "Neural search combines lexical retrieval with dense retrieval.",
    8: "Beginner tutorial for Python and data analysis with pandas.",
}
QUERIES = {1: "python data retrieval", 2: "search ranking bm25", 3: "italian pasta guide",
           4: "astronomy", 5: "data data python"}


def brute_force(corpus, query, bag, k1=1.5, b=0.75):
    """Scores straight from the formula, one document after the other."""
    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    docs = {d: Counter(split(t)) for d, t in corpus.items()}
    sizes = {d: sum(c.values()) for d, c in docs.items()}
    mean = sum(sizes.values()) / len(sizes)
    terms = split(query) if bag else sorted(set(split(query)))
    scores = {}
    for d, counts in docs.items():
        total, hit = 0.0, False
        for term in terms:
            if term in counts:
                df = sum(term in c for c in docs.values())
                idf = math.log((len(docs) - df + 0.5) / (df + 0.5) + 1)
                tf = counts[term]
                total += idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[d] / mean))
                hit = True
        if hit:
            scores[d] = round(total, 9)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))


@pytest.fixture(scope="module")
def tutorial(make_index):
    return make_index(TUTORIAL, analyzer=ascii_words)


def ranked(df, query_id):
    return [(d, pytest.approx(s, abs=2e-9)) for d, s in
            rows(df.filter(F.col("query_id") == query_id).orderBy("rank"), "doc_id", "score")]


@pytest.mark.parametrize("mode", ["set", "bag"])
@pytest.mark.parametrize("k1,b", [(1.5, 0.75), (0.8, 0.0), (0.0, 0.75)])
def test_topk_equals_brute_force(tutorial, as_queries, mode, k1, b):
    found = bm25.bm25_topk(tutorial, as_queries(QUERIES), k1, b, 3, mode).cache()
    for q, text in QUERIES.items():
        assert brute_force(TUTORIAL, text, mode == "bag", k1, b)[:3] == ranked(found, q)
    found.unpersist()


def test_smoke_expectations(make_index, as_queries):
    names = dict(enumerate(SMOKE))
    idx = make_index({i: SMOKE[name] for i, name in names.items()})
    texts = dict(enumerate(EXPECTED))
    found = bm25.bm25_topk(idx, as_queries(texts))
    for q, text in texts.items():
        urls = [names[d] for d, _ in ranked(found, q)]
        assert urls[:len(EXPECTED[text])] == EXPECTED[text]


def test_parts_beyond_the_broadcast_limit_give_the_same(tutorial, as_queries):
    whole = bm25.bm25_topk(tutorial, as_queries(QUERIES))
    parts = bm25.bm25_topk(tutorial, as_queries(QUERIES), limit=200)
    assert parts._jdf.queryExecution().toString().count("WindowGroupLimit") > 4
    assert sorted(rows(whole)) == sorted(rows(parts))


def test_many_terms_are_joined(monkeypatch, tutorial, as_queries):
    few = rows(bm25.bm25_topk(tutorial, as_queries(QUERIES)))
    monkeypatch.setattr(bm25, "NARROW_TERMS", 2)
    many = bm25.bm25_topk(tutorial, as_queries(QUERIES))
    assert "In(token_id" not in many._jdf.queryExecution().toString()
    assert sorted(rows(many)) == sorted(few)


def test_scores_are_added_without_a_shuffle(tutorial, as_queries):
    found = bm25.bm25_topk(tutorial, as_queries(QUERIES))
    plan = found._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "Bucketed: true" in physical
    # The only exchanges by key: the distinct query words and the final top k.
    assert "Exchange hashpartitioning(query_id#" in physical
    assert "hashpartitioning(doc_id" not in physical and "SortMergeJoin" not in physical
    assert "row_number(), 10, Partial" in physical


def test_few_terms_reach_the_scan(tutorial, as_queries):
    found = bm25.bm25_topk(tutorial, as_queries({1: "python data"}))
    plan = found._jdf.queryExecution().toString()
    assert "In(token_id, [" in plan


def test_hot_term_in_every_document(make_index, as_queries):
    texts = {i: "the " * (i % 5 + 1) + f"w{i % 7}" for i in range(300)}
    found = bm25.bm25_topk(make_index(texts), as_queries({1: "the w3"}), top_k=300)
    assert [d for d, _ in brute_force(texts, "the w3", False)] == [d for d, _ in ranked(found, 1)]
    assert found.count() == 300


def test_top_k_zero_and_negative(tutorial, as_queries):
    assert bm25.bm25_topk(tutorial, as_queries(QUERIES), top_k=0).count() == 0
    with pytest.raises(ValueError):
        bm25.bm25_topk(tutorial, as_queries(QUERIES), top_k=-1)


def test_rank_all_includes_documents_without_a_match(tutorial, as_queries):
    found = bm25.bm25_rank_all(tutorial, as_queries(QUERIES), top_k=5)
    for q, text in QUERIES.items():
        scored = dict(brute_force(TUTORIAL, text, True))
        expected = sorted(((d, scored.get(d, 0.0)) for d in TUTORIAL),
                          key=lambda x: (-x[1], x[0]))[:5]
        assert expected == ranked(found, q)


def test_explain_adds_up_to_the_score(spark, tutorial, as_queries):
    pairs = spark.createDataFrame([(1, 1), (5, 6), (4, 2)], "query_id long, doc_id long")
    found = bm25.bm25_explain(tutorial, as_queries(QUERIES), pairs)
    parts = {}
    for q, d, i, term, part in rows(found.orderBy("term_index"), "query_id", "doc_id", "term_index",
                                    "term", "contribution"):
        parts.setdefault((q, d), []).append((term, part))
    assert [t for t, _ in parts[5, 6]] == ["data", "data", "python"]
    assert parts[5, 6][0] == parts[5, 6][1] and parts[5, 6][2] == ("python", 0.0)
    assert parts[4, 2] == [("astronomy", 0.0)]
    expected = dict(brute_force(TUTORIAL, QUERIES[1], True))[1]
    assert sum(p for _, p in parts[1, 1]) == pytest.approx(expected, abs=1e-8)


def test_sweep(tutorial, as_queries):
    grid = [(0.8, 0.3), (1.2, 0.75), (2.0, 0.9)]
    found = bm25.bm25_sweep(tutorial, as_queries({1: "search retrieval ranking"}), grid)
    best = {(k1, b): (d, s) for k1, b, d, s in rows(found, "k1", "b", "doc_id", "score")}
    for k1, b in grid:
        doc, score = brute_force(TUTORIAL, "search retrieval ranking", True, k1, b)[0]
        assert best[k1, b] == (doc, pytest.approx(score, abs=2e-9))


def test_planned_index_gives_the_same_ranking(spark, tutorial, as_queries):
    docs = tutorial.document.select("doc_id", "full_text", "url", "title")
    planned = index.build_index(docs, ascii_words)
    assert sorted(rows(bm25.bm25_topk(planned, as_queries(QUERIES)))) == sorted(
        rows(bm25.bm25_topk(tutorial, as_queries(QUERIES))))


def test_legacy(make_index, as_queries):
    texts = {1: "x a b a", 2: "a b", 3: "b c c c"}
    idx = make_index(texts)
    matched = legacy.matched_tokens(idx, as_queries({1: "a b"})).cache()
    assert sorted(rows(legacy.legacy_match(matched), "doc_id", "num_matched_tokens",
                       "num_locations")) == [(1, 2, 3), (2, 2, 2), (3, 1, 1)]
    eps = 1e-5
    frequency = {1: 1.0, 2: (2 + eps) / (3 + eps), 3: (1 + eps) / (3 + eps)}
    assert dict(rows(legacy.legacy_frequency(matched), "doc_id", "score")) == pytest.approx(frequency)
    # Document 3 starts with its match, so the best sum is 0 and every score is 0.
    assert set(dict(rows(legacy.legacy_position(matched), "doc_id", "score")).values()) == {0.0}
    ranking = rows(legacy.legacy_rank(matched), "doc_id", "score")
    assert [d for d, _ in ranking] == [1, 2, 3]
    assert dict(ranking) == pytest.approx({d: 1.5 * f / 2.5 for d, f in frequency.items()}, abs=1e-8)
    matched.unpersist()
    # Without such a document the position score counts once per matched word.
    both = legacy.matched_tokens(make_index({1: "x a b", 2: "x x a"}), as_queries({1: "a b"}))
    position = {1: 2 / (3 + eps), 2: 2 / (2 + eps)}
    expected = {1: (1.5 * 1 + position[1] * 2) / 2.5,
                2: (1.5 * (1 + eps) / (2 + eps) + position[2]) / 2.5}
    assert dict(rows(legacy.legacy_rank(both, 5), "doc_id", "score")) == pytest.approx(expected,
                                                                                     abs=1e-8)


def test_query_mode_is_checked(tutorial, as_queries):
    with pytest.raises(ValueError):
        bm25.bm25_topk(tutorial, as_queries(QUERIES), mode="both")


def test_pruning_is_only_used_when_asked_for(monkeypatch, tutorial, as_queries):
    def refuse(*_):
        raise AssertionError("pruned")
    monkeypatch.setattr(bm25, "PRUNE_POSTINGS", 0, raising=False)
    monkeypatch.setattr(bm25.pruning, "pruned_scores", refuse)
    assert rows(bm25.bm25_topk(tutorial, as_queries({1: "the cat"}))) is not None
    with pytest.raises(AssertionError, match="pruned"):
        bm25.bm25_topk(tutorial, as_queries({1: "the cat"}), prune=True)


@pytest.mark.parametrize("pairs,scores,block", [(1, 40, 1), (7, 4_000_000, 5), (10 ** 6, 0, 10 ** 6)])
def test_scores_of_blocks_equal_the_sums_of_all_pairs(spark, monkeypatch, pairs, scores, block):
    """Also with repeated documents, queries without an id and more copies than are asked for; no
    posting is repeated for the queries that ask for its word."""
    for name, value in (("BLOCK_PAIRS", pairs), ("BLOCK_SCORES", scores), ("BLOCK_ROWS", block)):
        monkeypatch.setattr(bm25.matching, name, value)
    texts = [(i % 37 if i % 11 else None, "all " * (i % 4 + 1) + f"w{i % 5} " * (i % 3) + f"v{i % 13}",
              None, None) for i in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, full_text string, url string, title string")
    planned = index.build_index(docs)
    asked = spark.createDataFrame(
        [(1, "all w1 v3"), (None, "all w2 w2"), (1, "v7"), (4, "none"), (5, "v2 v3 v4 w0"), (6, None)],
        "query_id long, text string")
    terms = bm25.query_terms(asked, planned.analyzer, "bag").cache()
    every = bm25.bm25_scores(planned, bm25.weighted_terms(planned, terms), 1.2, 0.5)
    expected = rows(bm25.topk.top_k(every, ["query_id"], bm25.topk.by_score(), 6))
    found = bm25.bm25_topk(planned, asked, 1.2, 0.5, 6, "bag")
    close = lambda found: sorted((str(q), r, str(d), pytest.approx(s, abs=3e-9))
                                 for q, d, s, r in found)
    assert close(expected) == sorted((str(q), r, str(d), s) for q, d, s, r in rows(found))
    swept = bm25.bm25_sweep(planned, asked, [(0.0, 1.0), (1.2, 0.5)], 6)
    assert close(expected) == sorted(
        (str(q), r, str(d), s) for k1, b, q, d, s, r in rows(swept) if (k1, b) == (1.2, 0.5))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "LeftSemi" in plan


def test_broadcast_words_need_no_library_in_the_tasks():
    table = bm25.matching.pa.table({"query_id": [1, None, 1], "token_id": [9, 9, 4],
                                    "weight": [1, 2, 1], "idf": [.5, .5, 2.0]})
    found = bm25.matching.packed(table)
    assert b"rankweave" not in pickle.dumps(found)
    assert [x.tolist() for x in found[1:]] == [[4, 9], [0, 1, 3], [0, 0, 1], [2.0, .5, 1.0]]
