"""Product-quantized search against exact search."""

from pathlib import Path

import numpy as np
import pytest

from conftest import rows
from rankweave.operators import product, vector
from rankweave.plans import registry

SCHEMA = "doc_id long, embedding array<float>"


def ids(df):
    found = {}
    for q, d in rows(df.orderBy("query_id", "rank"), "query_id", "doc_id"):
        found.setdefault(q, []).append(d)
    return found


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(12, 16))
    data = [(i, (middle[i % 12] + 0.7 * rng.normal(size=16)).tolist()) for i in range(1500)]
    docs = spark.createDataFrame(data + [(2000, [0.0] * 16), (2001, None)], SCHEMA).repartition(3)
    queries = spark.createDataFrame([(q, data[q * 7][1]) for q in range(20)],
                                    "query_id long, embedding array<float>")
    found = product.write_product_index(docs, str(tmp_path_factory.mktemp("product") / "i"),
                                        vector.train_cells(docs, 12), parts=4)
    return docs, queries, found


def test_recall_and_exact_scores(index):
    docs, queries, found = index
    exact = vector.vector_topk(docs, queries, 10)
    scores = {(q, d): s for q, d, s in rows(exact, "query_id", "doc_id", "score")}
    done = product.product_search(found, queries, 10, nprobe=6)
    for q, d, s in rows(done, "query_id", "doc_id", "score"):
        assert (q, d) not in scores or scores[q, d] == pytest.approx(s, abs=2e-6)
    few, all_ = ids(done), ids(exact)
    assert min(len(set(few[q]) & set(all_[q])) for q in all_) >= 7
    assert np.mean([len(set(few[q]) & set(all_[q])) / 10 for q in all_]) >= 0.95


def test_a_list_of_all_vectors_is_exact(index):
    docs, queries, found = index
    assert ids(product.product_search(found, queries, 10, short=200)) == \
        ids(vector.vector_topk(docs, queries, 10))


def test_every_vector_has_a_small_code(index):
    docs, _, found = index
    codes = rows(found.codes, "doc_id", "code")
    assert sorted(i for i, _ in codes) == list(range(1500))
    assert {len(c) for _, c in codes} == {4}


def test_parts_of_queries_and_no_queries(index):
    _, queries, found = index
    whole = ids(product.product_search(found, queries, 5))
    assert ids(product.product_search(found, queries, 5, limit=20_000)) == whole
    assert product.product_search(found, queries.limit(0), 5).count() == 0


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_registered_search_finds_nine_tenths_for_every_label(spark, sf_dir):
    if not Path(sf_dir).exists():
        pytest.skip("the tables are not here")
    exact, few = ids(registry.q_vector_topk(spark, sf_dir)), ids(registry.q_vector_product(spark, sf_dir))
    shares = [len(set(few[q]) & set(exact[q])) / len(exact[q]) for q in exact]
    print("recall", min(shares), np.mean(shares))
    assert min(shares) >= 0.9
