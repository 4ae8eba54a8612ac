import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from rankweave import session
from rankweave.operators import bm25, fusion, rerank
from rankweave.operators.embed import hashing_embedder
from rankweave.plans import hybrid

RANKING = "query_id long, doc_id long, doc_title string, score double, rank int"
DOCUMENT = "doc_id long, full_text string"


def ranking(spark, ids, query_id=1, titles=None):
    data = [(query_id, d, (titles or {}).get(d, f"t{d}"), 1.0 / n, n)
            for n, d in enumerate(ids, 1)]
    return spark.createDataFrame(data, RANKING)


def order(df):
    return [(d, pytest.approx(s, abs=1e-6)) for d, s in
            rows(df.orderBy("query_id", "rank"), "doc_id", "score")]


def test_rrf(spark):
    fused = fusion.reciprocal_rank_fusion([ranking(spark, [1, 2]), ranking(spark, [2, 3])])
    assert order(fused) == [(2, 1 / 62 + 1 / 61), (1, 1 / 61), (3, 1 / 62)]
    swapped = fusion.reciprocal_rank_fusion([ranking(spark, [2, 3]), ranking(spark, [1, 2])])
    assert dict(rows(swapped, "doc_id", "score")) == dict(rows(fused, "doc_id", "score"))
    empty = ranking(spark, [])
    assert rows(fusion.reciprocal_rank_fusion([empty, empty])) == []


def test_rrf_ties_keep_first_seen_order_and_last_title(spark):
    a = ranking(spark, [5, 1], titles={5: "first", 1: "first"})
    b = ranking(spark, [1, 5], titles={1: None, 5: "second"})
    c = ranking(spark, [9, 8])
    found = fusion.reciprocal_rank_fusion([a, b, c])
    assert rows(found.orderBy("rank"), "doc_id", "doc_title") == [
        (5, "second"), (1, None), (9, "t9"), (8, "t8")]


def test_rerank_with_a_model(spark):
    docs = spark.createDataFrame([(10, "zero"), (20, "one"), (30, "two")], DOCUMENT)
    queries = spark.createDataFrame([(1, "q")], "query_id long, text string")
    scores = {"zero": .8, "one": .1, "two": .95, "": 0.0}
    scorer = rerank.model_column(lambda qs, ds: [scores[d] for d in ds])
    found = rerank.rerank(queries, ranking(spark, [10, 20, 30]), docs, scorer, 2)
    assert order(found) == [(30, .95), (10, .8)]
    assert rows(rerank.rerank(queries, ranking(spark, []), docs, scorer, 2)) == []
    # A candidate whose document is gone is scored on an empty text.
    found = rerank.rerank(queries, ranking(spark, [10, 77]), docs, scorer)
    assert order(found) == [(10, .8), (77, 0.0)]
    assert rerank.rerank(queries, ranking(spark, [10]), docs, scorer, 0).count() == 0
    with pytest.raises(ValueError):
        rerank.rerank(queries, ranking(spark, [10]), docs, scorer, -1)


@pytest.mark.parametrize("model,message", [
    (lambda qs, ds: [1.0], "one score per pair"),
    (lambda qs, ds: [float("nan")] * len(ds), "no score"),
])
def test_rerank_holds_the_model_to_its_contract(spark, model, message):
    docs = spark.createDataFrame([(10, "a"), (20, "b")], DOCUMENT)
    queries = spark.createDataFrame([(1, "q")], "query_id long, text string")
    found = rerank.rerank(queries, ranking(spark, [10, 20]).coalesce(1), docs,
                          rerank.model_column(model))
    with pytest.raises(Exception, match=message):
        found.coalesce(1).collect()


def test_rerank_missing_score_is_an_error(spark):
    docs = spark.createDataFrame([(10, "a")], DOCUMENT)
    queries = spark.createDataFrame([(1, "q")], "query_id long, text string")
    found = rerank.rerank(queries, ranking(spark, [10]), docs,
                          lambda q, d: F.lit(None).cast("double"))
    with pytest.raises(Exception, match="no score"):
        found.collect()


def test_equal_scores_keep_the_prior_order(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], DOCUMENT)
    queries = spark.createDataFrame([(1, "q")], "query_id long, text string")
    found = rerank.rerank(queries, ranking(spark, [3, 1, 2]), docs, lambda q, d: F.lit(0.5))
    assert rows(found.orderBy("rank"), "doc_id") == [(3,), (1,), (2,)]


def stored(spark, path, n, buckets=4):
    """A store of `n` documents, as `forward` of an index is written."""
    from rankweave.sources import index
    docs = spark.range(n).select((F.col("id") * 3).alias("doc_id"),
                                 F.concat(F.lit("text "), "id").alias("full_text"),
                                 F.concat(F.lit("url "), "id").alias("url"),
                                 F.concat(F.lit("title "), "id").alias("title"))
    return index.write_index(docs, str(path), buckets=buckets, positions=False).document


@pytest.mark.parametrize("listed", [True, False])
def test_fetch_documents_by_list_and_by_join(spark, monkeypatch, tmp_path, listed):
    monkeypatch.setattr(session, "GROUP_BYTES", 1 if listed else 1 << 40)
    docs = stored(spark, tmp_path, 200)
    # One document is a candidate of most queries, some have no document.
    data = [(q, 21, "t", 1.0, 1) for q in range(100)] + [(q, q % 60, "t", .5, 2) for q in range(100)]
    found = rerank.fetch_documents(spark.createDataFrame(data, RANKING), docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("doc_id#" in plan and " IN (" in plan or "INSET" in plan) == listed
    assert sorted(rows(found, "query_id", "rank", "full_text")) == sorted(
        (q, r, "" if d % 3 else f"text {d // 3}") for q, d, _, _, r in data)


def test_texts_of_a_store_are_not_moved(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "GROUP_BYTES", 1 << 40)
    docs = stored(spark, tmp_path, 2000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = spark.range(500).select(F.col("id").alias("doc_id"))
        plan = session.picked(docs.select("doc_id", "full_text"), "doc_id",
                              wanted)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Only ids are exchanged: dealt out to be distinct, and again to the buckets at most.
    assert "Bucketed: true" in plan
    for line in plan.splitlines():
        assert "Exchange" not in line or "full_text" not in line


def test_a_text_is_moved_once_for_all_queries_that_want_it(spark, tmp_path):
    docs = stored(spark, tmp_path, 50)
    data = [(q, d, "t", 1.0, 1 + d // 3) for q in range(40) for d in (3, 6, 9)]
    queries = spark.createDataFrame([(q, f"query {q}") for q in range(40)],
                                    "query_id long, text string")
    pairs = rerank.fetch_pairs(queries, spark.createDataFrame(data, RANKING), docs)
    assert sorted(rows(pairs, "query_id", "doc_id", "rank", "text", "full_text")) == [
        (q, d, 1 + d // 3, f"query {q}", f"text {d // 3}") for q, d, *_ in sorted(data)]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    # The pairs are parted behind the join, so nothing with a text and a query is exchanged.
    assert plan.index("Generate") < plan.index("Join")
    for line in plan.splitlines():
        assert "Exchange" not in line or "full_text" not in line or "text#" not in line.replace(
            "full_text#", "")


LOOKUPS = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from rankweave import session
from rankweave.operators import rerank
sys.path.insert(0, {root!r} + "/tests")
from test_ranking import stored
spark = session.build_session("local[2]", spark__driver__extraJavaOptions="-Xss400k",
                              spark__ui__enabled="false", spark__sql__shuffle__partitions="2",
                              spark__checkpoint__dir={path!r}, spark__sql__warehouse__dir={path!r})
spark.sparkContext.setLogLevel("ERROR")
session.GROUP_BYTES = 1
docs = stored(spark, {path!r} + "/index", 60_000)
for n in (1, 900, 5_000, 50_000):
    wanted = spark.range(n).select((F.col("id") * 3).alias("doc_id"))
    found = rerank.fetch_documents(wanted, docs)
    assert found.filter("full_text <> ''").count() == n, n
    print("found", n)
"""


def test_lookups_of_any_size_pass_with_a_small_stack(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    run = subprocess.run([sys.executable, "-c", LOOKUPS.format(root=root, path=str(tmp_path))],
                         capture_output=True, text=True, timeout=400)
    assert run.stdout.split() == "found 1 found 900 found 5000 found 50000".split(), run.stderr[-3000:]


def test_explain_and_legacy_read_asked_words_and_documents_only(spark, tmp_path, as_queries):
    from rankweave.operators import legacy
    from rankweave.sources import index
    docs = spark.createDataFrame([(i, f"w{i % 5} x{i}", f"u{i}", "t") for i in range(50)],
                                 "doc_id long, full_text string, url string, title string")
    idx = index.write_index(docs, str(tmp_path / "i"))
    queries = as_queries({1: "w1 x6"})
    pairs = spark.createDataFrame([(1, 6)], "query_id long, doc_id long")
    plan = bm25.bm25_explain(idx, queries, pairs)._jdf.queryExecution().toString()
    assert "In(token_id" in plan
    found = legacy.matched_tokens(idx, queries)
    assert "In(token_id" in found._jdf.queryExecution().toString()
    assert found.filter("doc_id = 6").count() == 2 and found.count() == 11


def test_rerank_cosine(spark):
    vectors = spark.createDataFrame([(0, [-1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0]),
                                     (3, [0.0, 0.0])], "doc_id long, embedding array<double>")
    query = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    candidates = ranking(spark, [0, 1, 2, 3])
    assert order(rerank.rerank_cosine(candidates, query, vectors, 2)) == [(2, 1.0), (1, 0.5 ** 0.5)]
    assert order(rerank.rerank_cosine(candidates, query, vectors))[2:] == [(3, 0.0), (0, -1.0)]
    # Candidates and queries without a vector stay, with score 0.
    some = vectors.filter("doc_id <> 0").union(spark.createDataFrame([(4, None)], vectors.schema))
    more = ranking(spark, [0, 1, 4])
    assert order(rerank.rerank_cosine(more, query, some)) == [(1, 0.5 ** 0.5), (0, 0.0), (4, 0.0)]
    none = rerank.rerank_cosine(more, query.limit(0), some)
    assert order(none) == [(0, 0.0), (1, 0.0), (4, 0.0)]


def test_rerank_yes_probability(spark):
    docs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], DOCUMENT)
    queries = spark.createDataFrame([(1, "q")], "query_id long, text string")
    yes = {"a": .9, "b": .2, "c": .7}

    def model(prompts):
        assert all(p.startswith("<Instruct>: ") and "\n<Query>: q\n<Document>: " in p
                   for p in prompts)
        return np.array([[np.log(1 - yes[p[-1]]), np.log(yes[p[-1]])] for p in prompts])

    found = rerank.rerank_yes_prob(queries, ranking(spark, [0, 1, 2]), docs,
                                   rerank.logits_column(model), 2)
    assert order(found) == [(0, .9), (2, .7)]
    extreme = spark.range(1).select(
        rerank.yes_probability(F.lit(5000.0), F.lit(0.0)),
        rerank.yes_probability(F.lit(-5000.0), F.lit(0.0))).first()
    assert extreme[0] == pytest.approx(0) and extreme[1] == 1.0


def test_engine_end_to_end(spark, make_index, as_queries):
    idx = make_index({1: "python basics", 2: "asyncio in practice", 3: "garden"})
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [.8, .6]), (3, [0.0, 1.0])],
                                    "doc_id long, embedding array<float>")
    embed = lambda texts: [[1.0, 0.0]] * len(texts)
    judge = rerank.model_column(lambda qs, ds: [1.0 if "asyncio" in d else 0.1 for d in ds])
    engine = hybrid.HybridSearch(
        [hybrid.bm25_retriever(idx), hybrid.vector_retriever(vectors, embed, idx.document)],
        [lambda q, c: rerank.rerank(q, c, idx.document, judge, 20)])
    found = engine.search(as_queries({4: "python"}))
    assert rows(found.orderBy("rank"), "doc_id", "doc_title", "score")[0] == (2, "title 2", 1.0)
    assert found.count() == 3
    # Without rankers the fused ranking is the result.
    fused = hybrid.HybridSearch(engine.retrievers).search(as_queries({4: "python"}))
    assert rows(fused.orderBy("rank"), "doc_id")[0] == (1,)


def test_queries_are_wrapped_for_the_model(spark, as_queries, tmp_path):
    def embed(texts):
        assert texts == ["Instruct: Given a search query, retrieve relevant documents that answer "
                         "the query\nQuery: banana bread"]
        return [[3.0, 4.0]]
    found = hybrid.embed_queries(as_queries({1: "banana bread"}), embed, 2)
    assert found.first()["embedding"] == pytest.approx([.6, .8])
    assert hashing_embedder(8)(["a a b"]).shape == (1, 8)
