"""Benchmark decontamination by Wu-Manber search for many word sequences at once.

Benchmark items are cut into windows of ten words. For windows of one length a shift table says for
each block of two words how far the search may move on, and documents are read in such steps. Where
the shift is zero, the windows that end with this block and begin with the words found there are
compared word by word.

Words are runs of letters A-Z (lowered), digits and all characters beyond ASCII. Items shorter than
a window are searched as one window of their own length.

Defined cases: null and empty texts have no words, so nothing is found in them and as items they
are never found. Repeated item rows are one item; a null item id counts as an item whose name is
empty. Repeated documents get the same result. An empty benchmark finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import BROADCAST_BYTES, chunks as parts_below, materialize
from .common import per_text, raw_texts

WINDOW = 10
BLOCK = 2
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    """Lower-cases A-Z only: bytes beyond ASCII stay as they are."""
    return _WORD.findall(text.lower())


def windows(item: list[bytes], size: int = WINDOW) -> Iterable[tuple[bytes, ...]]:
    if len(item) <= size:
        return [tuple(item)] if item else []
    return [tuple(item[i:i + size]) for i in range(len(item) - size + 1)]


class WuManber:
    """Tables for sequences of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]], length: int):
        self.length = length
        self.block = min(BLOCK, length)
        self.most = length - self.block + 1
        self.shift: dict = {}
        # last block -> first block -> sequences that have both
        self.buckets: dict = {}
        self.names = patterns
        for pattern in patterns:
            for end in range(self.block, length + 1):
                block = self._key(pattern, end)
                self.shift[block] = min(self.shift.get(block, self.most), length - end)
            self.buckets.setdefault(self._key(pattern, length), {}).setdefault(
                self._key(pattern, self.block), set()).add(pattern)

    def _key(self, text, end: int):
        return text[end - 1] if self.block == 1 else (text[end - 2], text[end - 1])

    def search(self, text: list[bytes]) -> Iterable[tuple[int, tuple[bytes, ...]]]:
        """(start, sequence) of every occurrence."""
        shift, most, key = self.shift.get, self.most, self._key
        end, n, pairs = self.length, len(text), self.block == 2
        while end <= n:
            block = (text[end - 2], text[end - 1]) if pairs else text[end - 1]
            step = shift(block, most)
            if step:
                end += step
                continue
            start = end - self.length
            near = self.buckets[block].get(key(text, start + self.block))
            if near:
                found = tuple(text[start:end])
                if found in near:
                    yield start, found
            end += 1


def searchers(items: list[tuple[str, bytes]], size: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, dict] = {}
    for name, text in items:
        for window in windows(words(text), size):
            names = by_length.setdefault(len(window), {}).setdefault(window, [])
            if name not in names:
                names.append(name)
    return [WuManber(patterns, length) for length, patterns in sorted(by_length.items())]


def _finder(shared, size: int):
    def make():
        found_by = searchers(shared.value, size)

        def find(texts: pa.StringArray) -> list:
            n_words, spans, items = [], [], []
            for raw in raw_texts(texts):
                text = words(raw)
                hits, names = [], set()
                for searcher in found_by:
                    for start, window in searcher.search(text):
                        hits.append((start, start + searcher.length))
                        names.update(searcher.names[window])
                n_words.append(len(text))
                spans.append([{"start": a, "stop": b} for a, b in merged(hits)])
                items.append(sorted(names))
            return [n_words, spans, items]
        return find
    return make


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    result: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if result and start <= result[-1][1]:
            result[-1] = (result[-1][0], max(stop, result[-1][1]))
        else:
            result.append((start, stop))
    return result


FIELDS = "n_words bigint, spans array<struct<start: int, stop: int>>, items array<string>"


def find(docs: DataFrame, keep: list[str], benchmark: DataFrame, item_id: str = "item_id",
         text: str = "text", size: int = WINDOW, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The `keep` columns of every document, its number of words, the spans of words that stand in
    an occurrence of a window (start, stop; merged), and the names of the items found.

    The items are measured before they are sent to the workers. Beyond `limit` they are searched in
    parts, each in a pass over the documents, and the spans of all passes are merged.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("name"),
        F.coalesce(F.col("`text`").cast("string"), F.lit("")).alias("text"))
    parts = parts_below(items, "text", limit)
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)],
                       F.col(f"`{text}`").alias("whole"))
    if len(parts) == 1:
        found = _pass(spark, rows, names, parts[0], size)
    else:
        rows = rows.withColumn("old_spans", F.array().cast("array<struct<start:int,stop:int>>")) \
                   .withColumn("old_items", F.array().cast("array<string>"))
        for part in parts:
            rows = materialize(
                _pass(spark, rows, [*names, "whole", "old_spans", "old_items"], part, size).select(
                    *names, "whole", "n_words",
                    F.concat("old_spans", "spans").alias("old_spans"),
                    F.array_union("old_items", "items").alias("old_items")), "passes")
        found = rows.select(*names, "n_words", _merge(F.array_sort("old_spans")).alias("spans"),
                            F.array_sort("old_items").alias("items"))
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, keep)],
                        "n_words", "spans", "items")


def _pass(spark, rows: DataFrame, keep: list[str], part: DataFrame, size: int) -> DataFrame:
    shared = spark.sparkContext.broadcast(
        [(r["name"], r["text"].encode()) for r in part.collect()])
    return per_text(rows, keep, "whole", _finder(shared, size), FIELDS)


def _merge(spans):
    """Merge sorted spans inside the row."""
    kind = "array<struct<start:int,stop:int>>"
    return F.aggregate(
        spans, F.array().cast(kind),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["start"] <= F.element_at(done, -1)["stop"]),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["start"].alias("start"),
                F.greatest(x["stop"], F.element_at(done, -1)["stop"]).alias("stop")))))
        .otherwise(F.concat(done, F.array(x))))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their columns."""
    names = docs.columns
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(names)])
    found = find(numbered, numbered.columns, benchmark, text=f"d{names.index(text)}")
    return found.filter(F.size("items") == 0).select(
        *[F.col(f"d{i}").alias(c) for i, c in enumerate(names)])
