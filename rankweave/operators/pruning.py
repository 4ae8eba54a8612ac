"""Rank-safe pruning of BM25 by block maxima.

Every token has, in the index, the largest frequency and the smallest length of a document over all
its postings, and frequent tokens also for each block of documents. From these follows the most that
a query word can add to a score, for any `k1` and `b`, over all documents or within a block.

A search scores the documents of each query's rarest words first. The k-th best of these scores is a
threshold that the k best of all documents reach. The query's words are then put in order of what
they can add; those that cannot reach the threshold together are optional: no document with only
such words is among the best. So only documents with one of the other words are scored, those that
with the block's maxima of the optional words cannot reach the threshold are left out, and the
postings of optional words, which are the frequent ones, are added up for the documents left. Scores
and ranks are those of the full search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scoring
from ..session import BROADCAST_BYTES, in_list, materialize, measured
from ..sources.index import ALL_BLOCKS, LexicalIndex, block_of
from . import topk

# The threshold comes from words with so many postings for each wanted document.
PROBE = 4
# A token is looked up by list in the postings for up to so many tokens.
NARROW_TERMS = 1000
# For the rounding of scores and sums in another order.
MARGIN = 1e-6


def bounded_terms(index: LexicalIndex, terms: DataFrame, k1: float, b: float) -> DataFrame:
    """The terms with `doc_freq` and `most`, the most that each can add to a score."""
    avgdl = index.corpus_stats.select("avgdl").scalar()
    most = F.col("weight") * scoring.bm25_weight(
        F.col("idf"), F.col("max_tf"), F.col("min_len"), avgdl, k1, b)
    # The semi-join goes below the sums over segments.
    asked = F.broadcast(terms.select("token_id").distinct())
    whole = index.term_blocks.join(asked, "token_id", "left_semi").filter(
        F.col("block") == ALL_BLOCKS)
    return whole.join(F.broadcast(terms), "token_id").select(
        "query_id", "token_id", "weight", "idf", F.col("n").alias("doc_freq"), most.alias("most"))


def _postings(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    tokens = [r["token_id"] for r in terms.select("token_id").distinct()
              .limit(NARROW_TERMS + 1).collect()]
    rows = index.term_doc_stats
    return rows if len(tokens) > NARROW_TERMS else rows.filter(in_list("token_id", tokens))


def _parts(index: LexicalIndex, terms: DataFrame, k1: float, b: float) -> DataFrame:
    avgdl = index.corpus_stats.select("avgdl").scalar()
    part = F.col("weight") * scoring.bm25_weight(F.col("idf"), F.col("tf"), F.col("len"), avgdl,
                                                 k1, b)
    return _postings(index, terms).join(F.broadcast(terms), "token_id").select(
        "query_id", "doc_id", part.alias("part"))


def _sums(index: LexicalIndex, terms: DataFrame, k1: float, b: float) -> DataFrame:
    """`(query_id, doc_id, part)`: sums over the given terms, added up where the postings lie."""
    return _parts(index, terms, k1, b).groupBy("query_id", "doc_id").agg(
        F.sum("part").alias("part"))


def thresholds(index: LexicalIndex, bounded: DataFrame, k1: float, b: float, k: int) -> DataFrame:
    """`(query_id, least)`: a score that at least `k` documents reach, for queries that have one."""
    rarest = Window.partitionBy("query_id").orderBy("doc_freq", "token_id").rowsBetween(
        Window.unboundedPreceding, -1)
    probes = bounded.withColumn("before", F.coalesce(F.sum("doc_freq").over(rarest), F.lit(0)))
    probes = probes.filter(F.col("before") < PROBE * k).select(
        "query_id", "token_id", "weight", "idf")
    scores = _sums(index, probes, k1, b).withColumnRenamed("part", "score")
    best = topk.top_k(scores, ["query_id"], topk.by_score(), k, pieces=index.buckets)
    return best.filter(F.col("rank") == k).select(
        "query_id", (F.col("score") - MARGIN).alias("least"))


def split_terms(bounded: DataFrame, least: DataFrame) -> DataFrame:
    """The terms with `least` and whether they are `optional`."""
    order = Window.partitionBy("query_id").orderBy("most", "token_id")
    return (bounded.join(F.broadcast(least), "query_id", "left")
            .withColumn("reach", F.sum("most").over(order))
            .withColumn("optional", F.coalesce(F.col("reach") < F.col("least"), F.lit(False)))
            .drop("reach"))


def _room(index: LexicalIndex, optional: DataFrame, k1: float, b: float, limit: int) -> DataFrame:
    """`(query_id, block, room)`: the most that optional words add within a block. ALL_BLOCKS stands
    for the blocks without a row."""
    avgdl = index.corpus_stats.select("avgdl").scalar()
    whole = optional.groupBy("query_id").agg(F.sum("most").alias("room"))
    everywhere = whole.select("query_id", F.lit(ALL_BLOCKS).alias("block"), "room")
    # Tokens with rows by block have one for every block they are in; others count with their
    # maximum in every block.
    asked = F.broadcast(optional.select("token_id").distinct())
    by_block = index.term_blocks.join(asked, "token_id", "left_semi").filter(
        F.col("block") != ALL_BLOCKS)
    frequent = materialize(by_block.join(F.broadcast(optional), "token_id").select(
        "query_id", "token_id", "block", F.col("most").alias("whole"),
        (F.col("weight") * scoring.bm25_weight(F.col("idf"), F.col("max_tf"), F.col("min_len"),
                                               avgdl, k1, b)).alias("most")), "blocks")
    tokens = frequent.select("query_id", "token_id", "whole").distinct().groupBy("query_id").agg(
        F.sum("whole").alias("frequent_room"))
    blocks = (frequent.groupBy("query_id", "block").agg(F.sum("most").alias("here"))
              .join(F.broadcast(tokens), "query_id").join(F.broadcast(whole), "query_id")
              .select("query_id", "block",
                      (F.col("room") - F.col("frequent_room") + F.col("here")).alias("room")))
    return everywhere if measured(blocks)[1] > limit else blocks.unionByName(everywhere)


def pruned_scores(index: LexicalIndex, terms: DataFrame, k1: float, b: float, k: int,
                  limit: int = BROADCAST_BYTES) -> DataFrame:
    """`(query_id, doc_id, score)` of all documents that may be among the `k` best of a query."""
    if index.term_blocks is None:
        raise ValueError("the index has no block maxima")
    bounded = materialize(bounded_terms(index, terms, k1, b), "terms")
    least = materialize(thresholds(index, bounded, k1, b, k), "thresholds")
    asked = materialize(split_terms(bounded, least), "terms")
    columns = ["query_id", "token_id", "weight", "idf"]
    optional = asked.filter("optional")
    first = _sums(index, asked.filter("NOT optional").select(*columns), k1, b)
    if optional.isEmpty():
        return _rounded(first.withColumnRenamed("part", "score"))
    room = materialize(_room(index, optional.select(*columns, "most"), k1, b, limit), "room")
    here = room.filter(F.col("block") != ALL_BLOCKS).withColumnRenamed("room", "here")
    whole = room.filter(F.col("block") == ALL_BLOCKS).select("query_id", "room")
    left = (first.withColumn("block", block_of(F.col("doc_id"), index.blocks))
            .join(F.broadcast(here), ["query_id", "block"], "left")
            .join(F.broadcast(whole), "query_id", "left")
            .join(F.broadcast(least), "query_id", "left"))
    reach = F.col("part") + F.coalesce("here", "room", F.lit(0.0))
    left = materialize(left.filter(F.col("least").isNull() | (reach >= F.col("least"))).select(
        "query_id", "doc_id", "part"), "candidates")
    pairs = left.select("query_id", "doc_id")
    more = _parts(index, optional.select(*columns), k1, b)
    # Broadcast only if the candidates are few; otherwise both meet by a shuffle.
    more = more.join(F.broadcast(pairs) if measured(pairs)[1] <= limit else pairs,
                     ["query_id", "doc_id"])
    return _rounded(left.unionByName(more).groupBy("query_id", "doc_id").agg(
        F.sum("part").alias("score")))


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", scoring.rounded(F.col("score"), scoring.BM25_DIGITS))
