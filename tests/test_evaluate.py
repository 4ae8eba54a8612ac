import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from rankweave.operators import evaluate

RUN = "mode string, query_id long, doc_id string, score double, rank int"
QRELS = "query_id long, doc_id string, relevance int"


def as_run(spark, runs):
    data = [(mode, q, d, 1.0 / n, n) for mode, lists in runs.items()
            for q, docs in lists.items() for n, d in enumerate(docs, 1)]
    return spark.createDataFrame(data, RUN)


def as_qrels(spark, qrels):
    return spark.createDataFrame([(q, d, r) for q, rels in qrels.items() for d, r in rels.items()],
                                 QRELS)


def test_worked_example(spark):
    run = as_run(spark, {"m": {1: ["D9", "D2", "D7", "D5", "D1", "D3"]}})
    qrels = as_qrels(spark, {1: {"D2": 1, "D5": 1}})
    names = ("precision@1", "precision@3", "precision@5", "recall@1", "recall@3", "recall@5",
             "mrr@10", "mrr@1", "map", "ndcg@5")
    row = evaluate.query_metrics(run, qrels, names).first()
    assert [row[n] for n in names] == pytest.approx(
        [0, 1 / 3, .4, 0, .5, 1.0, .5, 0, .5, .651], abs=5e-4)


@pytest.mark.parametrize("places,expected", [((1, 2), 1.0), ((9, 10), 7 / 45)])
def test_average_precision(spark, places, expected):
    docs = [f"r{n}" if n in places else f"x{n}" for n in range(1, 12)]
    run = as_run(spark, {"m": {1: docs}})
    qrels = as_qrels(spark, {1: {f"r{n}": 1 for n in places}})
    assert evaluate.query_metrics(run, qrels, ("map",)).first()["map"] == pytest.approx(expected)


def brute_force(docs, rels, k):
    gains = [rels.get(d, 0) for d in docs]
    dcg = lambda g: sum(x / math.log2(i + 1) for i, x in enumerate(g, 1))
    hits = [i for i, g in enumerate(gains, 1) if g]
    return {
        f"ndcg@{k}": dcg(gains[:k]) / dcg(sorted(rels.values(), reverse=True)[:k]),
        "ndcg": dcg(gains) / dcg(sorted(rels.values(), reverse=True)),
        "map": sum((n / i) for n, i in enumerate(hits, 1)) / len(rels),
        f"recall@{k}": sum(i <= k for i in hits) / len(rels),
        f"mrr@{k}": 1 / hits[0] if hits and hits[0] <= k else 0.0,
        f"precision@{k}": sum(i <= k for i in hits) / k,
    }


def test_metrics_equal_brute_force_with_graded_and_hot_queries(spark, monkeypatch):
    # Small blocks, so that a query's hits are counted over many of them.
    monkeypatch.setattr(evaluate, "RANK_BLOCK", 7)
    rng = random.Random(3)
    pool = [f"d{i}" for i in range(400)]
    runs = {mode: {q: rng.sample(pool, 300 if q == 1 else 20) for q in range(1, 6)}
            for mode in ("a", "b")}
    qrels = {q: {d: rng.randint(1, 3) for d in rng.sample(pool, 250 if q == 1 else 15)}
             for q in range(1, 6)}
    names = tuple(brute_force(runs["a"][1], qrels[1], 10))
    found = {(r["mode"], r["query_id"]): [r[n] for n in names] for r in evaluate.query_metrics(
        as_run(spark, runs), as_qrels(spark, qrels), names).collect()}
    assert len(found) == 10
    for (mode, q), values in found.items():
        expected = brute_force(runs[mode][q], qrels[q], 10)
        assert values == pytest.approx([expected[n] for n in names])


def test_missing_queries(spark):
    run = as_run(spark, {"a": {1: ["x"], 9: ["x"]}, "b": {1: ["y"], 2: ["x"]}})
    qrels = as_qrels(spark, {1: {"x": 1}, 2: {"x": 1}})
    drop = evaluate.evaluate_run(run, qrels, ("mrr@10",))
    assert sorted(rows(drop)) == [("a", "mrr@10", 1.0, 1), ("b", "mrr@10", .5, 2)]
    zero = evaluate.evaluate_run(run, qrels, ("mrr@10",), missing="zero")
    assert sorted(rows(zero)) == [("a", "mrr@10", .5, 2), ("b", "mrr@10", .5, 2)]
    with pytest.raises(ValueError):
        evaluate.query_metrics(run, qrels, ("mrr@10",), missing="other")
    for bad in ("f1", "ndcg@0", "precision"):
        with pytest.raises(ValueError):
            evaluate.query_metrics(run, qrels, (bad,))


def test_compare_and_best_mode(spark):
    evaluation = spark.createDataFrame(
        [("bm25", "map", .5, 3), ("vector", "map", .5, 3), ("rrf", "map", .4, 3),
         ("bm25", "mrr@10", .1, 3), ("vector", "mrr@10", .2, 3), ("rrf", "mrr@10", .3, 3)],
        "mode string, metric string, score double, scored_queries long")
    modes = ["bm25", "vector", "rrf"]
    assert sorted(rows(evaluate.compare(evaluation, modes))) == [
        ("map", .5, .5, .4), ("mrr@10", .1, .2, .3)]
    assert sorted(rows(evaluate.best_mode(evaluation, modes))) == [
        ("map", "bm25", .5), ("mrr@10", "rrf", .3)]


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 100, 333])
def test_latency(spark, n):
    rng = random.Random(n)
    values = [rng.choice([0.25, 0.5, rng.random()]) for _ in range(n)]
    data = [("m", v) for v in values] + [("flat", 1.0)] * 3
    df = spark.createDataFrame(data, "mode string, seconds double")
    found = {r["mode"]: r for r in evaluate.latency_summary(df).collect()}
    expected = sorted(values)[max(0, math.ceil(.95 * n) - 1)] * 1000
    assert found["m"]["p95_ms"] == pytest.approx(expected, abs=1e-6)
    assert found["m"]["mean_ms"] == pytest.approx(sum(values) / n * 1000, abs=1e-6)
    assert (found["flat"]["n"], found["flat"]["p95_ms"]) == (3, 1000.0)


def test_latency_with_an_outlier_orders_a_narrow_band(spark):
    n = 200_000
    df = spark.range(n, numPartitions=4).select(F.lit("m").alias("mode"), F.when(
        F.col("id") == 7, F.lit(1e6)).otherwise((F.col("id") * 7919 % n) / n).alias("seconds"))
    found = evaluate.latency_summary(df).first()
    values = sorted(1e6 if i == 7 else i * 7919 % n / n for i in range(n))
    assert found["p95_ms"] == pytest.approx(values[math.ceil(.95 * n) - 1] * 1000, abs=1e-6)
    low, high = df.select(F.percentile_approx("seconds", [.95 - 2e-4, .95 + 2e-4], 10_000)).first()[0]
    assert sum(low <= v <= high for v in values) < n / 500
    assert evaluate.latency_summary(df.limit(0)).collect() == []


def test_modes_are_timed_stage_by_stage(spark, make_index, as_queries):
    from rankweave.plans import evaluation, hybrid
    idx = make_index({i: f"w{i % 3} x" for i in range(9)})
    retrieve = hybrid.bm25_retriever(idx, top_k=3)
    found = evaluation.measure_modes(as_queries({1: "w1", 2: "w2", 3: "x"}), retrieve, retrieve,
                                     lambda qs, ranking: ranking, slices=2).collect()
    seconds = {(r["slice"], r["mode"]): r["seconds"] for r in found}
    for i in {r["slice"] for r in found}:
        parts = [seconds[i, mode] for mode in evaluation.MODES]
        assert min(parts) > 0 and parts[2] > parts[0] + parts[1] and parts[3] > parts[2]
    summary = evaluate.latency_summary(spark.createDataFrame(found)).collect()
    assert {r["mode"] for r in summary} == set(evaluation.MODES)


def test_build_run_names_documents_by_url(spark):
    ranking = spark.createDataFrame([(1, 5, .9, 1), (1, 6, .8, 2), (1, 7, .7, 3)],
                                    "query_id long, doc_id long, score double, rank int")
    docs = spark.createDataFrame([(5, None), (6, "u6"), (7, "u7")], "doc_id long, url string")
    assert rows(evaluate.build_run(ranking, "m", docs).orderBy("rank")) == [
        ("m", 1, "u6", .8, 1), ("m", 1, "u7", .7, 2)]
    assert rows(evaluate.build_run(ranking, "m", depth=1)) == [("m", 1, 5, .9, 1)]
