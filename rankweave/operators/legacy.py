"""The older ranker: word frequency and closeness to the start, normalized and weighted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scoring
from ..session import (
    BROADCAST_BYTES, chunks, in_list, lookup_join, materialize, union_all,
)
from ..sources.index import LexicalIndex
from .bm25 import NARROW_TERMS, query_terms
from .lexical import token_id
from . import topk

# Fixed values.
EPSILON = 1e-5
FREQUENCY_WEIGHT = 1.5
POSITION_WEIGHT = 1.0


def matched_tokens(index: LexicalIndex, queries: DataFrame,
                   limit: int = BROADCAST_BYTES) -> DataFrame:
    """Per query, document and matched word: its occurrences and first position.

    Occurrences are reduced once per document and word, before queries that share the word see
    them. The words go to the Parquet reader, unless there are very many: positions are sorted by
    word inside a bucket, so it skips what no query asks for. They are bucketed by document, so neither this step nor the sums per document that
    follow need a shuffle.
    """
    terms = query_terms(queries, index.analyzer, "set", index.lexicon).select(
        "query_id", token_id(F.col("token")).alias("token_id"))
    parts = []
    for part in chunks(terms, "query_id", limit):
        words = part.select("token_id").distinct()
        rows = (index.token_position.filter(
            in_list("token_id", [r["token_id"] for r in words.collect()]))
            if words.limit(NARROW_TERMS + 1).count() <= NARROW_TERMS else
            index.token_position.join(F.broadcast(words), "token_id", "left_semi"))
        found = (rows.groupBy("doc_id", "token_id")
                 .agg(F.count(F.lit(1)).alias("locations"),
                      F.min("position").cast("long").alias("first_position")))
        parts.append(found.join(F.broadcast(part), "token_id").select(
            "query_id", "doc_id", "token_id", "locations", "first_position"))
    return union_all(parts)


def legacy_match(matched: DataFrame) -> DataFrame:
    """Matched words and token locations per query and document."""
    return matched.groupBy("query_id", "doc_id").agg(
        F.count(F.lit(1)).alias("num_matched_tokens"),
        F.sum("locations").alias("num_locations"))


def frequency_scores(matched: DataFrame) -> DataFrame:
    """Occurrences of all query words, before normalization."""
    return matched.groupBy("query_id", "doc_id").agg(
        F.sum("locations").cast("double").alias("score"))


def position_scores(matched: DataFrame) -> DataFrame:
    """Sum of the first positions, with the number of rows the ranker counts it for."""
    return matched.groupBy("query_id", "doc_id").agg(
        F.sum("first_position").cast("double").alias("score"),
        F.count(F.lit(1)).alias("times"))


def _best(scores: DataFrame, *extremes: Column) -> DataFrame:
    """Extreme scores per query, written down: one row per query, to be joined back.

    A window over the query would bring all its documents into one task.
    """
    return materialize(scores.groupBy("query_id").agg(*extremes))


def legacy_normalize(scores: DataFrame, lower_is_better: bool = False) -> DataFrame:
    """Scale by the best score of the query.

    If lower is better and the best score is 0, all documents get 0, as in the older ranker.
    """
    best = _best(scores, (F.min("score") if lower_is_better else F.max("score")).alias("_best"))
    scaled = (F.col("_best") / (F.col("score") + F.lit(EPSILON)) if lower_is_better
              else (F.col("score") + F.lit(EPSILON)) / (F.col("_best") + F.lit(EPSILON)))
    return lookup_join(scores, best, "query_id").withColumn("score", scaled).drop("_best")


def legacy_frequency(matched: DataFrame) -> DataFrame:
    return legacy_normalize(frequency_scores(matched))


def legacy_position(matched: DataFrame) -> DataFrame:
    """One normalized score per document, `times` telling how often the ranker adds it."""
    return legacy_normalize(position_scores(matched), lower_is_better=True)


def legacy_rank(matched: DataFrame, top_k: int | None = None) -> DataFrame:
    """Weighted mean of both scores; the position score counts once per matched word.

    All matching documents, sorted best first per query by a distributed sort; with `top_k` the
    best ones with their rank.
    """
    both = matched.groupBy("query_id", "doc_id").agg(
        F.sum("locations").cast("double").alias("frequency"),
        F.sum("first_position").cast("double").alias("position"),
        F.count(F.lit(1)).alias("times"))
    best = _best(both, F.max("frequency").alias("_most"), F.min("position").alias("_nearest"))
    eps = F.lit(EPSILON)
    frequency = (F.col("frequency") + eps) / (F.col("_most") + eps)
    position = F.col("_nearest") / (F.col("position") + eps)
    total = F.lit(FREQUENCY_WEIGHT + POSITION_WEIGHT)
    score = (F.lit(FREQUENCY_WEIGHT) * frequency
             + F.lit(POSITION_WEIGHT) * position * F.col("times")) / total
    scored = (lookup_join(both, best, "query_id")
              .select("query_id", "doc_id",
                      scoring.rounded(score, scoring.BM25_DIGITS).alias("score")))
    if top_k is None:
        return scored.orderBy("query_id", *topk.by_score())
    return topk.top_k(scored, ["query_id"], topk.by_score(), top_k)
