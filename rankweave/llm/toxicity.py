"""Toxicity by logistic regression with the FTRL-proximal rule.

Features are words and their stems (first bytes), pairs of neighbouring words, three words in a row,
and pairs with one word skipped, each hashed to a place; a feature counts once in a document however often it occurs. Every
place has its own learning rate, and an L1 term keeps places at exactly zero until there is enough
evidence, so few weights are left. They are sent to the workers as a short sorted list, and whole
texts are scored in one map step.

Learning uses a bounded sample of labelled documents (`sample`), in one task.

Defined cases: null and empty texts have no features and get the probability of the learned offset.
Without labelled rows every score is 0.5. Repeated rows get the same score; null ids are scored but
not learned from.
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

SAMPLE = 12_000
TABLE_BITS = 20
PASSES = 4
LEAST_DOCUMENTS = 3
STEMS = (4, 5, 6)       # bytes of a word that make its stems
ALPHA, BETA, L1, L2 = 0.5, 1.0, 4.0, 1.0


def feature_groups(raw: np.ndarray, places: np.ndarray
                   ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in the table, first, last) for each kind of feature."""
    raw = hashing.lowered(raw)
    words, ends = hashing.word_hashes(raw, places, hashing.LETTERS_AND_DIGITS)
    for size in STEMS:
        stems, _ = hashing.word_hashes(raw, places, hashing.LETTERS_AND_DIGITS, size)
        yield (hashing.slots(hashing.mixed(stems + np.uint64(size)), TABLE_BITS),
               *hashing.spans(ends, 0))
    neighbours = hashing.pairs(words, 1, 1)
    triples = hashing.pairs(neighbours, 1, 3)
    for hashes, lost in ((words, 0), (neighbours, 1), (triples, 2),
                         (hashing.pairs(words, 2, 2), 2)):
        yield hashing.slots(hashes, TABLE_BITS), *hashing.spans(ends, lost)


@dataclass
class Model:
    places: np.ndarray   # with a weight other than zero, ascending
    weights: np.ndarray
    offset: float

    def scores(self, texts: pa.StringArray) -> np.ndarray:
        """Each place counts once in a text; only hits of known places are looked at twice."""
        raw, ends = text_bytes(texts)
        table = np.zeros(1 << TABLE_BITS, bool)
        table[self.places] = True
        seen = []
        for rows, first, last in feature_groups(raw, ends):
            hit = np.flatnonzero(table[rows])
            text = np.searchsorted(first, hit, side="right") - 1
            inside = (hit < last[text]) & (text >= 0) if len(hit) else np.zeros(0, bool)
            seen.append((text[inside] << TABLE_BITS) | rows[hit[inside]])
        pairs = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
        weight = self.weights[np.searchsorted(self.places, pairs & ((1 << TABLE_BITS) - 1))] \
            if len(pairs) else np.zeros(0)
        total = np.bincount(pairs >> TABLE_BITS, weights=weight, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.offset, -50, 50)))


def learn(texts: pa.StringArray, labels: np.ndarray, passes: int = PASSES) -> Model:
    """FTRL-proximal over documents in random order; the offset has no L1 term."""
    bias = 1 << TABLE_BITS
    documents = []
    for start, stop in slices(texts):  # one slice at a time bounds the memory of the features
        groups = list(feature_groups(*text_bytes(texts.slice(start, stop - start))))
        documents += [np.unique(np.concatenate([rows[first[i]:last[i]]
                                                for rows, first, last in groups])).astype(np.int32)
                      for i in range(stop - start)]
    seen = np.zeros(bias, np.int32)
    for places in documents:
        seen[places] += 1
    # A feature of very few documents names these rather than a kind of text.
    for i, places in enumerate(documents):
        documents[i] = np.append(places[seen[places] >= LEAST_DOCUMENTS], bias).astype(np.int32)
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)

    def weights(z: np.ndarray, n: np.ndarray, free: bool) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        if free:
            shrunk[-1] = z[-1]
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    rng = np.random.default_rng(0)
    for _ in range(passes):
        for i in rng.permutation(len(documents)):
            at = documents[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni, True)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -50, 50))) - labels[i]
            more = ni + gradient * gradient
            z[at] = zi + gradient - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[at] = more
    final = weights(z, n, True)
    places = np.flatnonzero(final[:-1])
    return Model(places, final[places], float(final[-1]))


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
        yield pd.DataFrame({"places": [model.places.astype("<i8").tobytes()],
                            "weights": [model.weights.astype("<f8").tobytes()],
                            "offset": [model.offset]})

    found = chosen.mapInPandas(fit, "places binary, weights binary, offset double").collect()
    if not found:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    return Model(np.frombuffer(found[0]["places"], "<i8"),
                 np.frombuffer(found[0]["weights"], "<f8"), found[0]["offset"])


def score(docs: DataFrame, keep: list[str], model: Model, text: str = "text") -> DataFrame:
    """The `keep` columns and `score`, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: [pa.array(shared.value.scores(texts))]
    return per_text(docs, keep, text, make, "score double")
