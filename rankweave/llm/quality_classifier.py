"""A quality classifier over learned subword embeddings.

A document is the average of the vectors of its words, word pairs and groups of three and four
bytes, each hashed to a row of a table (all pairs of a word with itself to the same row); a softmax layer turns the average into the probability of a
label. Vectors and layer are learned together by stochastic gradient descent over a bounded sample
of labelled documents (`sample`), in one task.

Since the layer is linear, the difference of the two outputs is the average of one number per row of
the table. Scoring uses those numbers: whole texts, no sampling, one map step.

Defined cases: null and empty texts have no features and get the probability of the learned offsets.
Without labelled rows every score is 0.5; with labels of one kind the scores tend to that label.
Repeated rows get the same score; null ids are scored but not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import hashing, sampling
from .common import per_text, slices, text_bytes

SAMPLE = 6000
TABLE_BITS = 17
DIMS = 12
GRAMS = (3, 4)
TWICE = np.uint64(0x123456789ABCDEF1)  # any word that stands twice in a row
PASSES = 4
RATE = 0.5


def feature_groups(raw: np.ndarray, places: np.ndarray
                   ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the table, first, last): for each kind of feature its rows in order and the part of
    them that belongs to each text."""
    raw = hashing.lowered(raw)
    words, ends = hashing.word_hashes(raw, places, hashing.NO_SPACE)
    yield hashing.slots(words, TABLE_BITS), *hashing.spans(ends, 0)
    neighbours = hashing.pairs(words, 1, 1)
    neighbours[words[:-1] == words[1:]] = TWICE
    yield hashing.slots(neighbours, TABLE_BITS), *hashing.spans(ends, 1)
    for size in GRAMS:
        yield (hashing.slots(hashing.byte_grams(raw, size), TABLE_BITS),
               *hashing.spans(places, size - 1))


@dataclass
class Model:
    weights: np.ndarray  # per row of the table: its share in the difference of the outputs
    offset: float

    def scores(self, texts: pa.StringArray) -> np.ndarray:
        raw, places = text_bytes(texts)
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for rows, first, last in feature_groups(raw, places):
            total += hashing.span_sums(self.weights[rows], first, last)
            count += last - first
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.offset)))


def learn(texts: pa.StringArray, labels: np.ndarray, passes: int = PASSES) -> Model:
    """Stochastic gradient descent, one document a step, with a falling rate."""
    rng = np.random.default_rng(0)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (1 << TABLE_BITS, DIMS)).astype(np.float32)
    layer = np.zeros((DIMS, 2), np.float32)
    bias = np.zeros(2, np.float32)
    documents = []
    for start, stop in slices(texts):  # one slice at a time bounds the memory of the features
        groups = list(feature_groups(*text_bytes(texts.slice(start, stop - start))))
        for i in range(stop - start):
            rows, counts = np.unique(np.concatenate(
                [r[first[i]:last[i]] for r, first, last in groups]), return_counts=True)
            documents.append((rows.astype(np.int32),
                              (counts / max(1, counts.sum())).astype(np.float32)))
    steps, step = max(1, passes * len(documents)), 0
    for _ in range(passes):
        for i in rng.permutation(len(documents)):
            rows, share = documents[i]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = share @ vectors[rows]
            out = mean @ layer + bias
            out = np.exp(out - out.max())
            out /= out.sum()
            out[labels[i]] -= 1
            back = layer @ out
            layer -= rate * np.outer(mean, out)
            bias -= rate * 0.1 * out
            # A vector's share in the average is tiny; its steps are scaled by the number of rows.
            vectors[rows] -= rate * min(len(rows), 50) * share[:, None] * back
    difference = layer[:, 1] - layer[:, 0]
    return Model(vectors @ difference, float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from about `sample` of the documents (doc_id, text) that have a label (doc_id, label;
    0 or 1)."""
    chosen = sampling.labelled_sample(docs, sample, labels).selectExpr(
        "text", "CAST(label AS INT) AS label").coalesce(1)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_rows = pd.concat(list(batches) or [pd.DataFrame({"text": [], "label": []})])
        if not len(all_rows):
            return
        all_rows = all_rows.sort_values(["text", "label"], kind="stable")
        model = learn(pa.array(all_rows["text"], pa.string()),
                      all_rows["label"].to_numpy(np.int64))
        yield pd.DataFrame({"weights": [model.weights.astype("<f4").tobytes()],
                            "offset": [model.offset]})

    found = chosen.mapInPandas(fit, "weights binary, offset double").collect()
    if not found:
        return Model(np.zeros(1 << TABLE_BITS, np.float32), 0.0)
    return Model(np.frombuffer(found[0]["weights"], "<f4"), found[0]["offset"])


def score(docs: DataFrame, keep: list[str], model: Model, text: str = "text") -> DataFrame:
    """The `keep` columns and `score`, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: [pa.array(shared.value.scores(texts))]
    return per_text(docs, keep, text, make, "score double")
