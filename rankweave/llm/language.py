"""Language identification by prediction by partial matching.

For each language a context tree over bytes is learned: how often each byte followed each context of
up to three bytes. A text's code length under a language is the sum over its bytes of the length of
that byte in its longest known context; a byte not seen there costs an escape (method C: as likely as
the number of different bytes seen in the context) and is looked up in the next shorter one, down to
256 equally likely bytes. Statistics are frozen after learning, so a byte's length depends on the
last four bytes alone and is worked out once for each different group of four in a slice of texts.
The shortest code wins; the score is its share of the probabilities 2^-length.

Learning uses a bounded sample (`texts_per_language`); languages are learned side by side in tasks.

Defined cases: null texts and texts without a letter are `und` with score 0. Ties go to the first
language in alphabetical order. Without any learnable row everything is `und`. Repeated rows get the
same result; null ids are predicted but not learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import sampling
from .common import per_text, text_bytes

ORDER = 3
TEXTS_PER_LANGUAGE = 400
BEFORE = 10  # a text is read as if line feeds stood before it
_LETTER = regex.compile(r"\p{L}")


def grams(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Each byte with the three before it, the byte itself lowest."""
    starts = places[:-1][np.diff(places) > 0]
    result = raw.astype(np.uint32)
    last = raw
    for k in range(1, ORDER + 1):
        before = np.empty_like(last)
        before[1:] = last[:-1]
        before[starts] = BEFORE
        result |= before.astype(np.uint32) << np.uint32(8 * k)
        last = before
    return result


@dataclass
class Level:
    """One order of a language's tree."""
    grams: np.ndarray      # known (context, byte), ascending
    lengths: np.ndarray    # bits of the byte in this context
    contexts: np.ndarray   # known contexts, ascending
    escapes: np.ndarray    # bits of an escape from the context


def learn(codes: np.ndarray) -> list[Level]:
    """The tree over groups of four bytes."""
    levels = []
    for order in range(ORDER + 1):
        low = np.uint32((1 << 8 * (order + 1)) - 1) if order < 3 else np.uint32(0xFFFFFFFF)
        known, n = np.unique(codes & low, return_counts=True)
        contexts, first, different = np.unique(known >> np.uint32(8), return_index=True,
                                               return_counts=True)
        total = np.add.reduceat(n, first) + different
        lengths = np.log2(np.repeat(total, different) / n)
        levels.append(Level(known, lengths, contexts, np.log2(total / different)))
    return levels


def _lookup(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return place, known[place] == asked


def code_lengths(levels: list[Level], codes: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each group of four."""
    bits = np.full(len(codes), 8.0)
    for order, level in enumerate(levels):
        low = np.uint32((1 << 8 * (order + 1)) - 1) if order < 3 else np.uint32(0xFFFFFFFF)
        asked = codes & low
        place, seen = _lookup(level.grams, asked)
        context, known = _lookup(level.contexts, asked >> np.uint32(8))
        bits = np.where(seen, level.lengths[place],
                        np.where(known, level.escapes[context] + bits, bits))
    return bits


_PARTS = ("grams", "lengths", "contexts", "escapes")


def _learn_group(key: tuple, texts: pd.DataFrame) -> pd.DataFrame:
    raw, places = text_bytes(pa.array(texts["text"], pa.string()))
    row = {"label": [key[0]]}
    if len(raw):
        for i, level in enumerate(learn(grams(raw, places))):
            row |= {f"{part}{i}": [getattr(level, part).tobytes()] for part in _PARTS}
        return pd.DataFrame(row)
    return pd.DataFrame(columns=["label", *(f"{p}{i}" for i in range(ORDER + 1) for p in _PARTS)])


def train(rows: DataFrame, texts_per_language: int = TEXTS_PER_LANGUAGE
          ) -> list[tuple[str, list[Level]]]:
    """Trees by language from `doc_id, text, label`; one small row per language comes back."""
    columns = ", ".join(f"{p}{i} binary" for i in range(ORDER + 1) for p in _PARTS)
    sample = sampling.labelled_sample(rows, texts_per_language, by_label=True)
    found = sample.groupBy("label").applyInPandas(_learn_group, f"label string, {columns}")
    types = {"grams": np.uint32, "lengths": np.float64, "contexts": np.uint32,
             "escapes": np.float64}
    return sorted((r["label"], [Level(**{p: np.frombuffer(r[f"{p}{i}"], types[p])
                                         for p in _PARTS}) for i in range(ORDER + 1)])
                  for r in found.collect())


def score_texts(models: list[tuple[str, list[Level]]], texts: pa.StringArray
                ) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    raw, places = text_bytes(texts)
    n = len(texts)
    total = np.zeros((n, len(models)))
    filled = np.flatnonzero(np.diff(places) > 0)
    if len(filled) and models:
        coded = pa.array(grams(raw, places)).dictionary_encode()
        which = coded.indices.to_numpy()
        different = coded.dictionary.to_numpy()
        for i, (_, levels) in enumerate(models):
            bits = code_lengths(levels, different)[which]
            total[filled, i] = np.add.reduceat(bits, places[:-1][filled])
    langs, scores = [], []
    for text, bits in zip(texts.to_pylist(), total):
        if not models or not text or not _LETTER.search(text):
            langs.append("und")
            scores.append(0.0)
            continue
        best = int(np.argmin(bits))
        langs.append(models[best][0])
        scores.append(float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()))
    return langs, scores


def identify(docs: DataFrame, keep: list[str], models: list[tuple[str, list[Level]]],
             text: str = "text") -> DataFrame:
    """The `keep` columns, `lang_pred` and `score` of every document, in one map step.

    The trees are sent to the workers; the bounded sample bounds their size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def make():
        trees = shared.value
        return lambda texts: list(score_texts(trees, texts))
    return per_text(docs, keep, text, make, "lang_pred string, score double")
