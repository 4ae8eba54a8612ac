"""Scoring the candidates of a ranking again, with the document text or stored vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scoring
from ..functions.text import QUERY_TASK
from ..functions.vectors import cosine
from ..session import materialize, picked
from . import topk

# A scorer as an expression of (query text, document text) ...
ColumnScorer = Callable[[Column, Column], Column]
# ... or as a model: two equally long lists in, one score per pair out.
ModelScorer = Callable[[list[str], list[str]], "np.ndarray | list[float]"]


def fetch_documents(candidates: DataFrame, document: DataFrame) -> DataFrame:
    """Candidates with `full_text`; a candidate without a document gets an empty text.

    The texts are looked up by id, in the buckets and row groups of the store that hold one, and
    each is moved once at most, however many candidates want it. The candidates are read more than
    once: give a ranking that is written down.
    """
    found = picked(document.select("doc_id", "full_text"), "doc_id", candidates)
    return (candidates.join(found, "doc_id", "left")
            .withColumn("full_text", F.coalesce("full_text", F.lit(""))))


# Queries that want the same document, in one row, at most.
ASKED_TOGETHER = 4096


def fetch_pairs(queries: DataFrame, candidates: DataFrame, document: DataFrame,
                tasks: int | None = None) -> DataFrame:
    """The candidates with the query's `text` and the document's `full_text`.

    Pairs are gathered by document before the texts come in and parted again behind them, in the
    same task. So a text is moved once for all queries that want it (of a document wanted by very
    many, once for every some thousand of them).
    """
    names = candidates.columns
    asked = candidates.join(queries.select("query_id", "text"), "query_id")
    n = queries.count() // ASKED_TOGETHER + 1
    group = F.pmod(F.xxhash64("query_id"), F.lit(n))
    by_document = asked.groupBy("doc_id", group.alias("_group")).agg(
        F.collect_list(F.struct(*[c for c in names if c != "doc_id"], "text")).alias("_asked"))
    rows = fetch_documents(materialize(by_document, "asked"), document)
    if tasks is not None:
        rows = rows.repartition(tasks, "doc_id", "_group")
    return rows.select("doc_id", "full_text", F.inline("_asked")).select(
        *names, "text", "full_text")


def model_column(score: ModelScorer) -> ColumnScorer:
    """Run a model over Arrow batches of (query, document) pairs."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, documents in batches:
            scores = np.asarray(score(queries.tolist(), documents.tolist()), dtype=float)
            if scores.shape != (len(queries),):
                raise ValueError("the model must return one score per pair")
            if np.isnan(scores).any():
                raise ValueError("the model returned no score for a pair")
            yield pd.Series(scores)

    return run


def _checked(top_k: int | None) -> int | None:
    if top_k is not None and top_k < 0:
        raise ValueError("top_k must be non-negative")
    return top_k


def _ranked(scored: DataFrame, top_k: int | None) -> DataFrame:
    """Replace the rank; equal scores keep the order of the prior ranking."""
    prior = scored.withColumnRenamed("rank", "_prior")
    ranked = topk.top_k(prior, ["query_id"], [F.col("score").desc(), F.col("_prior").asc()], top_k)
    columns = ["query_id", "doc_id", "doc_title", "score", "rank"]
    return ranked.select(*[c for c in columns if c in ranked.columns])


def rerank(queries: DataFrame, candidates: DataFrame, document: DataFrame,
           scorer: ColumnScorer, top_k: int | None = 20,
           digits: int | None = scoring.VECTOR_DIGITS, tasks: int | None = None) -> DataFrame:
    """Score every (query, candidate text) pair and keep the best.

    `scorer` is an expression or `model_column(model)`. A missing score is an error. No candidates
    give no rows. Spark sizes tasks by bytes; for a slow model set `tasks`, and the documents are
    dealt out evenly over so many.
    """
    _checked(top_k)
    pairs = fetch_pairs(queries, candidates, document, tasks)
    score = scorer(F.col("text"), F.col("full_text"))
    score = F.coalesce(score, F.raise_error(F.lit("a candidate got no score")).cast("double"))
    if digits is not None:
        score = scoring.rounded(score, digits)
    return _ranked(pairs.withColumn("score", score).drop("text", "full_text"), top_k)


def rerank_cosine(candidates: DataFrame, query_vectors: DataFrame, document_vectors: DataFrame,
                  top_n: int | None = None) -> DataFrame:
    """Order candidates by cosine similarity of stored vectors.

    `query_vectors` holds `(query_id, embedding)`, `document_vectors` `(doc_id, embedding)`. No
    candidate is lost: one without a stored vector, of a query without one, or with a vector that is
    null or without direction scores 0, as the product with a zero vector does.
    """
    _checked(top_n)
    stored = document_vectors.select("doc_id", F.col("embedding").alias("_d"))
    found = picked(stored, "doc_id", candidates)
    asked = query_vectors.select("query_id", F.col("embedding").alias("_q"))
    pairs = candidates.join(found, "doc_id", "left").join(asked, "query_id", "left")
    score = F.coalesce(cosine(F.col("_q"), F.col("_d")), F.lit(0.0))
    scored = pairs.withColumn("score", scoring.rounded(score, scoring.VECTOR_DIGITS))
    return _ranked(scored.drop("_q", "_d"), top_n)


# The form of the prompt that judging models are given.
def judge_prompt(query: Column, document: Column,
                 instruction: str = QUERY_TASK) -> Column:
    return F.concat(F.lit(f"<Instruct>: {instruction}\n<Query>: "), query,
                    F.lit("\n<Document>: "), document)


def yes_probability(no_logit: Column, yes_logit: Column) -> Column:
    """Softmax of two logits, the part of "yes"; safe for large values."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(no_logit - yes_logit, F.lit(700.0))))


def rerank_yes_prob(queries: DataFrame, candidates: DataFrame, document: DataFrame,
                    logits: Callable[[Column], Column], top_n: int | None = None,
                    instruction: str = QUERY_TASK) -> DataFrame:
    """Ask a judging model about each pair; the score is its probability of "yes".

    `logits` turns the prompt into an array of the (no, yes) logits: an expression, or
    `logits_column(model)`.
    """
    def scorer(query: Column, text: Column) -> Column:
        pair = logits(judge_prompt(query, text, instruction))
        return yes_probability(pair[0], pair[1])

    return rerank(queries, candidates, document, scorer, top_n)


def logits_column(model: Callable[[list[str]], np.ndarray]) -> Callable[[Column], Column]:
    """Run a model that returns (no, yes) logits for a list of prompts."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            out = np.asarray(model(prompts.tolist()), dtype=float)
            if out.shape != (len(prompts), 2):
                raise ValueError("the model must return two logits per prompt")
            yield pd.Series(list(out))

    return run
