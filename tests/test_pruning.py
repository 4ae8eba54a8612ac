"""Pruned searches against full ones, and what they spare."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from rankweave.operators import bm25, pruning
from rankweave.sources import index


@pytest.fixture(scope="module")
def corpus(make_index):
    """One word is in every document, some in most, others in few."""
    rng = np.random.default_rng(11)
    common, rare = [f"c{i}" for i in range(5)], [f"r{i}" for i in range(60)]
    texts = {}
    for i in range(3000):
        words = ["the"] * int(rng.integers(1, 4))
        words += list(rng.choice(common, int(rng.integers(3, 25))))
        words += list(rng.choice(rare, int(rng.integers(0, 3))))
        texts[i] = " ".join(words)
    texts[3000] = "the the the the the"
    texts[3001] = ""
    return make_index(texts, buckets=4)


QUERIES = {1: "the r1 r2", 2: "the c0 c1 c2", 3: "the", 4: "r5 r6 r7 c1 the c3", 5: "unknown",
           6: "the the r9 r9 c0", 7: "r1"}


@pytest.mark.parametrize("k, k1, b", [(1, 1.5, 0.75), (10, 0.0, 0.3), (200, 2.0, 1.0)])
def test_same_ranks_as_the_full_search(corpus, as_queries, k, k1, b):
    queries = as_queries(QUERIES)
    mode = "bag" if k == 10 else "set"
    full = rows(bm25.bm25_topk(corpus, queries, k1, b, k, mode=mode, prune=False))
    done = rows(bm25.bm25_topk(corpus, queries, k1, b, k, mode=mode, prune=True))
    assert sorted(done) == sorted(full) and full


def test_blocks_of_a_large_table_are_left_out(corpus, as_queries):
    queries = as_queries(QUERIES)
    full = rows(bm25.bm25_topk(corpus, queries, top_k=5, prune=False))
    assert sorted(rows(bm25.bm25_topk(corpus, queries, top_k=5, prune=True, limit=100))) == \
        sorted(full)


def test_few_rows_enter_the_sums(corpus, as_queries):
    queries = as_queries({1: "the r1 r2", 4: "r5 r6 the c3"})
    (_, terms), = bm25._term_chunks(corpus, queries, "set", 1 << 26)
    every = bm25.match_postings(corpus, terms).count()
    scored = pruning.pruned_scores(corpus, terms, 1.5, 0.75, 10)
    bounded = pruning.bounded_terms(corpus, terms, 1.5, 0.75)
    least = pruning.thresholds(corpus, bounded, 1.5, 0.75, 10)
    asked = pruning.split_terms(bounded, least)
    needed = asked.filter("NOT optional").agg(F.sum("doc_freq")).first()[0]
    assert asked.filter("optional").count() >= 2
    # The words of every document are optional; documents with rare ones are few.
    assert needed * 10 < every and scored.count() * 20 < every


def test_bounds_hold_for_every_posting(corpus):
    by_block = corpus.term_blocks.filter(F.col("block") != index.ALL_BLOCKS)
    assert by_block.count() > 0
    post = corpus.term_doc_stats.withColumn("block", index.block_of(F.col("doc_id"), corpus.blocks))
    for bounds, keys in ((by_block, ["token_id", "block"]),
                         (corpus.term_blocks.filter(F.col("block") == index.ALL_BLOCKS),
                          ["token_id"])):
        told = bounds.select(*keys, "n", "max_tf", "min_len")
        found = post.groupBy(*keys).agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"),
                                        F.min("len").alias("min_len"))
        tokens = told.select("token_id").distinct()
        assert sorted(rows(told)) == sorted(rows(found.join(tokens, "token_id", "left_semi")
                                                 .select(told.columns)))
