"""Embeddings from a model function, in Arrow batches, with its contract checked."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

# A model: texts in, one vector per text out, in the same order.
EmbedFunction = Callable[[list[str]], "np.ndarray | list[list[float]]"]


class TransientModelError(Exception):
    """Raised by a model function for a failure that is worth another try, such as overload."""


@dataclass(frozen=True)
class EmbedPolicy:
    """How model calls are cut and repeated.

    A batch the model rejects (`ValueError`) is halved until single texts remain; a single text
    that is rejected `max_tries` times gets an error instead of a vector. A transient failure is
    repeated with doubling delays and fails the task in the end.
    """
    batch_size: int = 100
    max_tries: int = 8
    delay: float = 2.0
    max_delay: float = 60.0
    bisect: bool = True

    def __post_init__(self):
        if self.batch_size <= 0 or self.max_tries <= 0 or self.delay < 0:
            raise ValueError("batch_size and max_tries must be positive, delay not negative")

    def pauses(self) -> list[float]:
        """Seconds to wait before each try."""
        return [0.0] + [min(self.delay * 2 ** i, self.max_delay)
                        for i in range(self.max_tries - 1)]


def _checked(vectors, n: int, dims: int | None, normalize: bool) -> np.ndarray:
    """Hold the model to its contract: one numeric vector per text, all of the expected width."""
    if len(vectors) != n:
        raise ValueError(f"model returned {len(vectors)} vectors for {n} texts")
    widths = {len(v) for v in vectors}
    if len(widths) > 1:
        raise ValueError("model returned vectors of different widths")
    if dims is not None and widths and widths != {dims}:
        raise ValueError(f"model returned width {widths.pop()} instead of {dims}")
    matrix = np.asarray(vectors, dtype=float).reshape(n, -1)
    if normalize:
        lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        matrix = matrix / np.where(lengths == 0, 1.0, lengths)
    return matrix


def _ask(embed: EmbedFunction, texts: list[str], dims: int | None, normalize: bool,
         policy: EmbedPolicy, sleep: Callable[[float], None]) -> np.ndarray | str:
    """Vectors of some texts, or the reason why the model does not take them.

    Only what another try may change is tried again: a busy model, and a refused single text. A
    refused group is left to the caller, who can cut it.
    """
    reason, busy = "", None
    for pause in policy.pauses():
        if pause:
            sleep(pause)
        try:
            return _checked(embed(texts), len(texts), dims, normalize)
        except TransientModelError as error:
            busy = error
        except ValueError as error:
            reason, busy = str(error), None
            if len(texts) > 1:
                break
    if busy is not None:
        raise busy
    return reason


def embed_with_policy(embed: EmbedFunction, texts: list[str], dims: int | None, normalize: bool,
                      policy: EmbedPolicy, sleep: Callable[[float], None] = time.sleep
                      ) -> list[tuple[np.ndarray | None, str | None]]:
    """`(vector, error)` per text, in order.

    Spans of texts that still need an answer wait on a list; each answer fills its places.
    """
    answers: list[tuple[np.ndarray | None, str | None]] = [(None, None)] * len(texts)
    waiting = [(0, len(texts))] if texts else []
    while waiting:
        first, stop = waiting.pop()
        found = _ask(embed, texts[first:stop], dims, normalize, policy, sleep)
        if not isinstance(found, str):
            answers[first:stop] = [(vector, None) for vector in found]
        elif policy.bisect and stop - first > 1:
            middle = (first + stop) // 2
            waiting += [(middle, stop), (first, middle)]
        else:
            answers[first:stop] = [(None, found)] * (stop - first)
    return answers


def embed_documents(rows: DataFrame, embed: EmbedFunction, text: str = "full_text",
                    dims: int | None = None, normalize: bool = True,
                    policy: EmbedPolicy = EmbedPolicy(), missing_only: bool = False) -> DataFrame:
    """All columns of `rows` plus `embedding` and `embed_error`. A map step, without a shuffle.

    A null text is embedded as the empty text. A row whose text the model refuses keeps a null
    embedding and the reason, and does not fail the job. With `missing_only` rows that have an
    embedding pass through as they are.
    """
    if dims is not None and dims <= 0:
        raise ValueError(f"vectors of {dims} values cannot be asked for")
    stored = F.col("embedding").cast("array<float>") if missing_only else F.lit(None)
    rows = rows.withColumn("_stored", stored.cast("array<float>")).drop("embedding", "embed_error")
    schema = T.StructType([*rows.drop("_stored").schema.fields,
                           T.StructField("embedding", T.ArrayType(T.FloatType())),
                           T.StructField("embed_error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors, errors = list(frame["_stored"]), [None] * len(frame)
            texts = [t or "" for t in frame[text]]
            waiting = [i for i, v in enumerate(vectors) if v is None]
            for at in range(0, len(waiting), policy.batch_size):
                places = waiting[at:at + policy.batch_size]
                results = embed_with_policy(embed, [texts[i] for i in places], dims, normalize,
                                            policy)
                for i, (vector, error) in zip(places, results):
                    vectors[i] = None if vector is None else vector.astype(np.float32)
                    errors[i] = error
            yield frame.drop(columns="_stored").assign(
                embedding=pd.Series(vectors, index=frame.index, dtype=object), embed_error=errors)

    return rows.mapInPandas(run, schema)


def embedding_audit(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: vectors, nulls, smallest and largest width."""
    width = F.when(F.col(column).isNotNull(), F.size(column))
    return vectors.agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if(F.col(column).isNull()).alias("null_embeddings"),
        F.min(width).alias("min_dim"),
        F.max(width).alias("max_dim"),
    )


# Words that a task keeps the places of.
KNOWN_WORDS = 500_000


class _Places(dict):
    """The place of each word, `dims` further on if the word counts as -1."""

    def __init__(self, dims: int):
        super().__init__()
        self.dims = dims

    def __missing__(self, word: str) -> int:
        digest = hashlib.md5(word.encode()).hexdigest()
        place = int(digest[:8], 16) % self.dims + (self.dims if digest[8] >= "8" else 0)
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = place
        return place

    def __reduce__(self):
        return _Places, (self.dims,)


def hashing_embedder(dims: int = 64, pattern: str = r"[^\W_]+") -> EmbedFunction:
    """A deterministic stand-in for a model: each word adds +1 or -1 to one of `dims` places.

    The place is the first eight hex digits of the word's MD5 modulo `dims`; the sign is minus
    when the ninth digit is 8 or more. Words are hashed once for all the texts of a task.
    """
    find = re.compile(pattern).findall
    places = _Places(dims)

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in zip(out, texts):
            found = np.array([places[word] for word in find(text.lower())], dtype=np.int64)
            counts = np.bincount(found, minlength=2 * dims)
            row += counts[:dims] - counts[dims:]
        return out

    return embed
