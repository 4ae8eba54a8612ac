"""BM25 retrieval for a whole table of queries at once; one query is a one-row table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from ..functions import scoring
from ..functions.text import Analyzer
from ..session import (
    BROADCAST_BYTES, in_list, materialize, measured, picked, split, union_all,
)
from ..sources.index import LexicalIndex
from .lexical import lemmatize, token_id
from . import matching, pruning, topk

# Postings of one bucket that a part of the queries may ask for, counted once per query.
BUCKET_POSTINGS = 20_000_000
# Up to so many words, the reader is given the list of them.
NARROW_TERMS = 1000


def query_terms(queries: DataFrame, analyzer: Analyzer, mode: str = "set",
                lexicon: DataFrame | None = None) -> DataFrame:
    """`(query_id, token, weight)`: each word once (`set`), or weighted by repetition (`bag`)."""
    if mode not in ("set", "bag"):
        raise ValueError("query_terms must be 'set' or 'bag'")
    tokens = queries.select("query_id", F.explode(analyzer(F.col("text"))).alias("token"))
    tokens = lemmatize(tokens, lexicon)
    if mode == "set":
        return tokens.distinct().withColumn("weight", F.lit(1).cast("long"))
    return tokens.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("weight"))


def weighted_terms(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """Add token id and idf; words the corpus does not know drop out."""
    total = index.corpus_stats.select("total_docs").scalar()
    # The terms are the small side: the caller measured them. The semi-join goes below the sums of
    # a streamed index, which are then taken for the words of the queries only.
    known = (index.token.join(F.broadcast(terms.select("token")), "token", "left_semi")
             .join(F.broadcast(terms), "token"))
    return known.select("query_id", "token", "token_id", "weight",
                        scoring.idf(total, F.col("doc_freq")).alias("idf"))


def match_postings(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """Postings of the query terms, once per query that asks for the term.

    The terms are broadcast, so the postings stay where they are, and a word that is in almost
    every document is handled by all tasks alike.
    """
    return index.term_doc_stats.join(F.broadcast(terms), "token_id")


def _narrowed(index: LexicalIndex, terms: DataFrame) -> LexicalIndex:
    """For few terms, let the Parquet reader skip the row groups without them."""
    few = terms.select("token", token_id(F.col("token")).alias("token_id")).distinct().collect()
    return replace(
        index,
        token=index.token.filter(in_list("token", [row["token"] for row in few])),
        term_doc_stats=index.term_doc_stats.filter(
            in_list("token_id", [row["token_id"] for row in few])))


def _term_chunks(index: LexicalIndex, queries: DataFrame, mode: str,
                 limit: int) -> list[tuple[LexicalIndex, DataFrame]]:
    """Weighted terms in parts of whole queries, each small enough to be broadcast and with no more
    postings to a bucket than a task can add up."""
    terms = query_terms(queries, index.analyzer, mode, index.lexicon)
    rows, size = measured(terms)
    size *= 2  # a joined term carries two numbers more than the measured one
    few = rows <= NARROW_TERMS
    narrow = _narrowed(index, terms) if few else index
    if not few:
        work = (index.token.join(terms.select("token"), "token")
                .agg(F.coalesce(F.sum("doc_freq"), F.lit(0)).alias("n")).first()["n"])
        size = max(size, limit * (work // index.buckets) // BUCKET_POSTINGS)
    return [(narrow, weighted_terms(narrow, part))
            for part in split(terms, ["query_id"], size, limit)]


def bm25_scores(index: LexicalIndex, terms: DataFrame, k1: float, b: float) -> DataFrame:
    """`(query_id, doc_id, score)` of every document that has at least one query term."""
    avgdl = index.corpus_stats.select("avgdl").scalar()
    part = scoring.bm25_weight(F.col("idf"), F.col("tf"), F.col("len"), avgdl, k1, b)
    # Postings are bucketed by doc_id: all parts of a (query, document) pair are in one task
    # and this aggregation needs no shuffle.
    return (match_postings(index, terms)
            .groupBy("query_id", "doc_id")
            .agg(F.sum(F.col("weight") * part).alias("score"))
            .withColumn("score", scoring.rounded(F.col("score"), scoring.BM25_DIGITS)))


def _positive(k1: float, b: float) -> bool:
    """Whether every match adds to a score: what the formula is meant for."""
    return k1 >= 0 and 0 <= b <= 1


def bm25_topk(index: LexicalIndex, queries: DataFrame, k1: float | None = None,
              b: float | None = None, top_k: int | None = None, mode: str = "set",
              limit: int = BROADCAST_BYTES, prune: bool = False) -> DataFrame:
    """The best documents per query as `(query_id, doc_id, score, rank)`.

    `queries` holds `(query_id, text)`. Queries beyond the broadcast limit are run in parts, with
    one scan of the postings per part. A `k1`, `b` or `top_k` of 0 is taken as 0. With `prune`
    documents that cannot be among the best are not scored (see `pruning`), with the same result:
    for a few documents of queries with rare words. For many of long queries the candidates that it
    writes and shuffles cost more than the sums, which stay where the postings lie.
    """
    k1 = 1.5 if k1 is None else k1
    b = 0.75 if b is None else b
    k = 10 if top_k is None else top_k
    parts = _term_chunks(index, queries, mode, limit)
    # The bounds hold for what the formula is meant for: more occurrences score more, longer
    # documents less.
    if prune and k and _positive(k1, b):
        # Tokens are picked anew for each step, from the postings of all.
        scores = [pruning.pruned_scores(index, terms, k1, b, k, limit) for _, terms in parts]
    elif k > 0 and _positive(k1, b):
        scores = [matching.best_scores(part, terms, [(k1, b)], k).drop("setting")
                  for part, terms in parts]
    else:
        scores = [bm25_scores(part, terms, k1, b) for part, terms in parts]
    return union_all([topk.top_k(found, ["query_id"], topk.by_score(), k, pieces=index.buckets)
                      for found in scores])


def bm25_rank_all(index: LexicalIndex, queries: DataFrame, k1: float = 1.5, b: float = 0.75,
                  top_k: int = 5, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rank all documents, those without any query word with score 0; repeated words count.

    Only queries with fewer than `k` matches need such documents. A query then has at most
    `k - 1` matches, so its fillers are among the `2k` smallest document ids: queries times
    documents is never formed.
    """
    matched = materialize(bm25_topk(index, queries, k1, b, top_k, mode="bag", limit=limit))
    short = (queries.select("query_id")
             .join(matched.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")),
                   "query_id", "left")
             .filter(F.coalesce("n", F.lit(0)) < top_k).select("query_id"))
    first = (index.document.select("doc_id").orderBy("doc_id").limit(2 * top_k)
             .agg(F.collect_list("doc_id").alias("ids")).select("ids").scalar())
    fillers = (short.withColumn("doc_id", F.explode(first))
               .join(matched.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
               .withColumn("score", F.lit(0.0)))
    everything = matched.select("query_id", "doc_id", "score").unionByName(fillers)
    return topk.top_k(everything, ["query_id"], topk.by_score(), top_k)


def bm25_explain(index: LexicalIndex, queries: DataFrame, pairs: DataFrame, k1: float = 1.5,
                 b: float = 0.75, limit: int = BROADCAST_BYTES) -> DataFrame:
    """What each query word adds to the score of a document.

    `pairs` holds `(query_id, doc_id)`. One row per word of the query in its order, repeats
    included; a word the document does not have adds 0.
    """
    avgdl = index.corpus_stats.select("avgdl").scalar()
    pairs = materialize(pairs.select("query_id", "doc_id"))
    occurrences = (pairs.join(queries, "query_id")
                   .select("query_id", "doc_id",
                           F.posexplode(index.analyzer(F.col("text"))).alias("term_index", "token")))
    # The word as typed is reported; a lexicon only decides which posting it is looked up in.
    occurrences = occurrences.withColumn("term", F.col("token"))
    occurrences = lemmatize(occurrences, index.lexicon).withColumn(
        "token_id", token_id(F.col("token")))
    parts = []
    for narrow, terms in _term_chunks(index, queries, "set", limit):
        postings = picked(narrow.term_doc_stats, "doc_id", pairs)
        wanted = terms.join(pairs, "query_id")
        _, size = measured(wanted)
        wanted = F.broadcast(wanted) if size <= limit else wanted
        parts.append(postings.join(wanted, ["token_id", "doc_id"]).select(
            "query_id", "doc_id", "token_id",
            scoring.bm25_weight(F.col("idf"), F.col("tf"), F.col("len"), avgdl, k1, b)
            .alias("part")))
    parts = union_all(parts)
    return (occurrences.join(parts, ["query_id", "doc_id", "token_id"], "left")
            .select("query_id", "doc_id", "term_index", "term",
                    scoring.rounded(F.coalesce("part", F.lit(0.0)), scoring.BM25_DIGITS)
                    .alias("contribution")))


def bm25_sweep(index: LexicalIndex, queries: DataFrame, params: list[tuple[float, float]],
               top_k: int = 1, mode: str = "bag", limit: int = BROADCAST_BYTES) -> DataFrame:
    """The best documents per query for each `(k1, b)`; the postings are read once for all."""
    if not params:
        raise ValueError("give at least one (k1, b)")
    if top_k > 0 and all(_positive(k1, b) for k1, b in params):
        settings = F.array(*[F.struct(F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b"))
                             for k1, b in params])
        found = [matching.best_scores(narrow, terms, params, top_k)
                 .withColumn("_pair", settings[F.col("setting")])
                 .select("_pair.k1", "_pair.b", "query_id", "doc_id", "score")
                 for narrow, terms in _term_chunks(index, queries, mode, limit)]
        return union_all([topk.top_k(scores, ["k1", "b", "query_id"], topk.by_score(), top_k,
                                     pieces=index.buckets) for scores in found])
    avgdl = index.corpus_stats.select("avgdl").scalar()
    # One row per query and document, with a score for every pair, so the postings that enter the
    # aggregation do not depend on the number of pairs.
    sums = [F.sum(F.col("weight") * scoring.bm25_weight(
        F.col("idf"), F.col("tf"), F.col("len"), avgdl, k1, b)).alias(f"s{i}")
        for i, (k1, b) in enumerate(params)]
    grid = F.array(*[F.struct(
        F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b"),
        scoring.rounded(F.col(f"s{i}"), scoring.BM25_DIGITS).alias("score"))
        for i, (k1, b) in enumerate(params)])
    results = []
    for narrow, terms in _term_chunks(index, queries, mode, limit):
        scores = (match_postings(narrow, terms).groupBy("query_id", "doc_id").agg(*sums)
                  .select("query_id", "doc_id", F.inline(grid)))
        results.append(topk.top_k(scores.select("k1", "b", "query_id", "doc_id", "score"),
                                  ["k1", "b", "query_id"], topk.by_score(), top_k,
                                  pieces=index.buckets))
    return union_all(results)


def attach_titles(ranking: DataFrame, document: DataFrame,
                  limit: int = BROADCAST_BYTES) -> DataFrame:
    """Add `doc_title`. The ranking is written down first, and titles are read for its documents
    only: their ids go to the Parquet reader."""
    done = materialize(ranking, "ranking")
    titles = document.select("doc_id", F.col("title").alias("doc_title"))
    found = picked(titles, "doc_id", done)
    size = measured(done)[1]
    return found.join(F.broadcast(done) if size <= limit else done, "doc_id").select(
        "query_id", "doc_id", "doc_title", "score", "rank")
