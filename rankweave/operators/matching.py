"""Postings of the query words added up to scores, for all queries of a part at once.

A posting enters the plan once, however many queries ask for its word. Rows of `(document, word,
part)` are added up where the postings lie, and a task multiplies them with the table of `(word,
query, weight)`, some documents at a time. Of these only scores that may be among the best `k` of
their query leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions import scoring
from ..sources.index import LexicalIndex

# Postings that are taken together; (posting, query) pairs and scores held at a time.
BLOCK_ROWS = 500_000
BLOCK_PAIRS = 1_000_000
BLOCK_SCORES = 4_000_000
EMIT_ROWS = 100_000
# With fewer pairs than one for so many (document, query) places, only the places met are held.
SPARSE = 4


class Asked:
    """The weighted words of a part: for each token id the queries that ask for it."""

    def __init__(self, names: pa.Array, token_ids: np.ndarray, starts: np.ndarray,
                 query: np.ndarray, weight: np.ndarray):
        self.names, self.token_ids, self.starts = names, token_ids, starts
        self.query, self.weight = query, weight


def packed(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What `Asked` is made of, without anything that only this library can read: a broadcast value
    names its classes, and tasks may not find the library."""
    names = table.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
    token_id = table.column("token_id").to_numpy()
    order = np.argsort(token_id, kind="stable")
    token_ids, starts = np.unique(token_id[order], return_index=True)
    query = names.indices.to_numpy(zero_copy_only=False)[order].astype(np.int64)
    weight = table.column("weight").to_numpy() * table.column("idf").to_numpy()
    return names.dictionary, token_ids, np.append(starts, len(order)), query, weight[order]


class Floors:
    """For each query a score that its best `k` reach, from the documents seen so far."""

    def __init__(self, queries: int, k: int, size: int):
        self.k = k
        self.least = np.zeros(queries)
        self.best = np.zeros((0, queries)) if k * queries <= size else None

    def seen(self, scores: np.ndarray) -> None:
        """`scores` is (documents, queries), 0 where there is no match."""
        if self.best is None:
            return
        self.best = np.vstack([self.best, scores])
        cut = len(self.best) - self.k
        if cut > 0:
            # A copy, so that the rest is freed.
            self.best = np.partition(self.best, cut, axis=0)[cut:].copy()
        if cut >= 0:
            self.least = scoring.rounded_array(self.best.min(axis=0), scoring.BM25_DIGITS)


def blocks_of_documents(batches: Iterator[pa.RecordBatch], size: int
                        ) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole documents and where each document starts. The rows of a document follow each
    other and say in `n` how many they are."""
    held, waiting, gone = [], 0, 0
    for batch in batches:
        held.append(batch)
        waiting += batch.num_rows
        if waiting < size:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts, end = _starts(table, gone)
        if starts:
            yield table.slice(0, end), np.array(starts)
            gone, table = 0, table.slice(end)
        elif (folded := _folded(table)).num_rows < table.num_rows:
            gone, table = gone + table.num_rows - folded.num_rows, folded
        held, waiting = table.to_batches(), table.num_rows
    table = pa.Table.from_batches(held).combine_chunks() if held else None
    if table is not None and table.num_rows:
        yield table, np.array(_starts(table, gone)[0])


def _starts(table: pa.Table, gone: int) -> tuple[list[int], int]:
    """Where the complete documents start, and the end of the last one. Of the first document so
    many rows are gone."""
    rows = table.column("n").to_numpy()
    starts, at = [], 0
    while at < len(rows) and (end := at + int(rows[at]) - (0 if at else gone)) <= len(rows):
        starts.append(at)
        at = end
    return starts, at


def _folded(table: pa.Table) -> pa.Table:
    """The rows of one document, such as all those without an id, with one row for each word."""
    parts = [name for name in table.column_names if name.startswith("part")]
    sums = table.group_by("token_id").aggregate([(name, "sum") for name in parts])
    columns = {name: sums.column(f"{name}_sum") for name in parts} | {
        "token_id": sums.column("token_id")}
    return pa.table([columns.get(name, table.column(name).slice(0, sums.num_rows))
                     for name in table.column_names], table.schema.names).cast(table.schema)


def _sums(asked: Asked, document: np.ndarray, token: np.ndarray, parts: list[np.ndarray],
          most_pairs: int) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """`first, last, place, scores` for runs of documents: per setting the scores at the places
    `(document - first) * queries + query`, or at all of them where `place` is None."""
    queries = len(asked.names)
    count = asked.starts[token + 1] - asked.starts[token]
    pairs = np.append(0, np.cumsum(count))
    ends = np.append(np.flatnonzero(np.diff(document)) + 1, len(document))
    at = 0
    while at < len(document):
        # As many documents as make up the pairs wanted, one at least.
        most = np.searchsorted(pairs[ends], pairs[at] + most_pairs, side="right")
        here = int(np.searchsorted(ends, at, side="right"))
        end = int(ends[max(here, most - 1)])
        first, last = int(document[at]), int(document[end - 1]) + 1
        row = np.repeat(np.arange(at, end), count[at:end])
        offset = np.arange(len(row)) - np.repeat(pairs[at:end] - pairs[at], count[at:end])
        offset += asked.starts[token[row]]
        place = (document[row] - first) * queries + asked.query[offset]
        weight, size, met = asked.weight[offset], (last - first) * queries, None
        if len(place) * SPARSE < size:
            met, place = np.unique(place, return_inverse=True)
            size = len(met)
        yield first, last, met, [np.bincount(place, part[row] * weight, size) for part in parts]
        at = end


def best_scores(index: LexicalIndex, terms: DataFrame, params: list[tuple[float, float]],
                k: int) -> DataFrame:
    """`(setting, query_id, doc_id, score)` of all documents that may be among the `k` best of a
    query, for each `(k1, b)`, numbered from 0.

    `k1` and `b` are such that every match scores more than 0. The terms were measured to be small.
    """
    spark = terms.sparkSession
    avgdl = index.corpus_stats.select("avgdl").scalar()
    part = [scoring.bm25_weight(F.col("idf"), F.col("tf"), F.col("len"), avgdl, k1, b)
            .alias(f"part{i}") for i, (k1, b) in enumerate(params)]
    # Postings are bucketed by doc_id: counting those of a document needs no shuffle, and puts them
    # one after the other.
    wanted = F.broadcast(terms.select("token_id", "idf").distinct())
    rows = (index.term_doc_stats.join(wanted, "token_id")
            .select("doc_id", "token_id", *part)
            .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
            .sortWithinPartitions("doc_id"))
    schema = T.StructType([
        T.StructField("setting", T.IntegerType()),
        T.StructField("query_id", terms.schema["query_id"].dataType),
        T.StructField("doc_id", index.term_doc_stats.schema["doc_id"].dataType),
        T.StructField("score", T.DoubleType())])
    # The idf of a word is in the parts already.
    asked_for = terms.select("query_id", "token_id", "weight", F.lit(1.0).alias("idf"))
    shared = spark.sparkContext.broadcast(packed(asked_for.toArrow()))
    settings = len(params)
    block_rows, block_pairs, block_scores = BLOCK_ROWS, BLOCK_PAIRS, BLOCK_SCORES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(*shared.value)
        queries = len(asked.names)
        floors = [Floors(queries, k, block_scores) for _ in range(settings)]
        for table, starts in blocks_of_documents(batches, block_rows):
            ids = table.column("doc_id").combine_chunks().take(pa.array(starts))
            document = np.zeros(table.num_rows, np.int64)
            document[starts[1:]] = 1
            document = np.cumsum(document)
            token = np.searchsorted(asked.token_ids, table.column("token_id").to_numpy())
            parts = [table.column(f"part{i}").to_numpy() for i in range(settings)]
            for first, last, met, found in _sums(asked, document, token, parts,
                                                   block_pairs):
                for i, (floor, scores) in enumerate(zip(floors, found)):
                    if met is None:
                        floor.seen(scores.reshape(last - first, queries))
                        place = np.flatnonzero(scores)
                        scores = scores[place]
                    else:
                        place = met
                    scores = scoring.rounded_array(scores, scoring.BM25_DIGITS)
                    query = place % queries
                    good = scores >= floor.least[query]
                    yield from _emit(i, asked.names.take(pa.array(query[good])),
                                     ids.take(pa.array(first + place[good] // queries)),
                                     scores[good])
    return rows.mapInArrow(run, schema)


def _emit(setting: int, query: pa.Array, document: pa.Array, score: np.ndarray
          ) -> Iterator[pa.RecordBatch]:
    number = np.full(len(score), setting, np.int32)
    whole = pa.RecordBatch.from_arrays([pa.array(number), query, document, pa.array(score)],
                                       names=["setting", "query_id", "doc_id", "score"])
    for at in range(0, len(score), EMIT_ROWS):
        yield whole.slice(at, EMIT_ROWS)
