"""Removal of repeated runs of lines, found by winnowing over line hashes.

A run is a row of consecutive lines with at least `min_words` words. Of a run that occurs several
times, in one document or in many, the first occurrence stays (by document id, then place) and the
lines of all later ones go.

Lines are hashed. Every shortest run that starts at a line is a window, and the least line hash in
it is its fingerprint, so two occurrences of a run of `min_words` words or more always share one;
since neighbouring windows mostly have the same least hash, there are few fingerprints. Those found
at one place only are dropped by a count that is combined in the map tasks. Around the remaining
positions matches are extended both ways: a line belongs to a repeated run exactly if a shortest run
that starts there, or a shortest run that ends there, or one around it, is repeated. So these runs,
named by a hash of their lines, are joined to the first place where each occurs, and every later one
marks its lines. Occurrences are compared with the first only, never with each other.

At least one copy of every line stays, because the first occurrence of a line has no earlier one.

Defined cases: a null text has no lines and stays null; an empty one has one line without words. A
run may hold lines without words. Rows without an id come last. Repeated rows (same id and text)
are one document and come out alike, rows of one id with other texts are documents of their own,
ordered by a hash of the text. A text all of whose lines go becomes empty. A very long text is handled
whole, by one task, in time and memory that grow with its lines: no run is read again, however many
lines without words it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialize
from .common import per_text, raw_texts, text_key

MIN_WORDS = 20
_MASK = (1 << 63) - 1
# Two primes below 2^61 and a base for each: names of runs that agree in both are the same run.
_PRIMES = ((1 << 61) - 1, (1 << 61) - 31)
_BASES = (1_173_906_287_345_210_897, 1_873_204_511_930_574_103)


def windows(counts: list[int], least: int) -> list[tuple[int, int]]:
    """(first, last) lines of the shortest run from each line on, where there is one."""
    found, total, stop = [], 0, 0
    for start, count in enumerate(counts):
        while total < least and stop < len(counts):
            total += counts[stop]
            stop += 1
        if total < least:
            break
        found.append((start, stop - 1))
        total -= count
    return found


def runs(counts: list[int], least: int) -> list[tuple[int, int]]:
    """Shortest runs that start, or that end, at each line."""
    n = len(counts)
    ahead = windows(counts, least)
    back = [(n - 1 - b, n - 1 - a) for a, b in windows(counts[::-1], least)]
    return sorted(set(ahead) | set(back))


def least_in_windows(hashes: list[int], spans: list[tuple[int, int]]) -> dict[int, int]:
    """For the first line of each window, the place of its least hash (the last one of equals)."""
    found: dict[int, int] = {}
    queue: list[int] = []
    head, seen = 0, 0
    for start, stop in spans:
        while seen <= stop:
            while len(queue) > head and hashes[queue[-1]] >= hashes[seen]:
                queue.pop()
            queue.append(seen)
            seen += 1
        while queue[head] < start:
            head += 1
        found[start] = queue[head]
    return found


def run_names(hashes: list[int], prime: int, base: int) -> Callable[[int, int], int]:
    """A function that names the run of lines from `first` to `last`, in the same time for runs of
    any length: a polynomial in the line hashes, as a difference of those of two beginnings."""
    begun, powers, total, power = [0], [1], 0, 1
    for value in hashes:
        total = (total * base + value + 1) % prime
        power = power * base % prime
        begun.append(total)
        powers.append(power)
    return lambda first, last: (begun[last + 1] - begun[first] * powers[last + 1 - first]) % prime


FIELDS = ("marks array<bigint>, "
          "runs array<struct<mark: bigint, r1: bigint, r2: bigint, start: int, stop: int>>")


def _winnow(least: int):
    def run(texts: pa.StringArray) -> list:
        marks: list[int] = []
        mark_ends, run_ends = [0], [0]
        columns: list[list[int]] = [[], [], [], []]
        r1: list[int] = []
        r2: list[int] = []
        for text in raw_texts(texts):
            lines = text.split(b"\n")
            counts = [len(line.split()) for line in lines]
            if sum(counts) >= least:
                digests = [xxhash.xxh3_128_intdigest(line) for line in lines]
                hashes = [x & _MASK for x in digests]
                names = [run_names(hashes, _PRIMES[0], _BASES[0]),
                         run_names([x >> 64 for x in digests], _PRIMES[1], _BASES[1])]
                place = least_in_windows(hashes, windows(counts, least))
                marks += [hashes[p] for p in sorted(set(place.values()))]
                for start, stop in runs(counts, least):
                    columns[0].append(hashes[place[start]])
                    columns[1].append(start)
                    columns[2].append(stop)
                    r1.append(names[0](start, stop))
                    r2.append(names[1](start, stop))
            mark_ends.append(len(marks))
            run_ends.append(len(r1))
        rows = pa.StructArray.from_arrays(
            [pa.array(np.array(columns[0], np.int64)), pa.array(r1, pa.int64()),
             pa.array(r2, pa.int64()),
             pa.array(np.array(columns[1], np.int32)), pa.array(np.array(columns[2], np.int32))],
            names=["mark", "r1", "r2", "start", "stop"])
        return [pa.ListArray.from_arrays(pa.array(mark_ends, pa.int32()),
                                         pa.array(marks, pa.int64())),
                pa.ListArray.from_arrays(pa.array(run_ends, pa.int32()), rows)]
    return lambda: run


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  min_words: int = MIN_WORDS) -> DataFrame:
    """`doc_id`, `text_key` and `spans`, the later occurrences of repeated runs in a document as
    (first line, last line). Documents without any are left out."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                       text_key(text).alias("text_key"))
    found = materialize(per_text(rows, ["doc_id", "text_key"], "text", _winnow(min_words), FIELDS)
                        .filter(F.size("runs") > 0), "winnowed")
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key",
                     F.col("run.start").alias("start"))
    # A repeated row has the same places as the row it repeats, which is no second occurrence.
    repeated = (found.select(F.explode("marks").alias("mark"))
                .groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark"))
    near = (found.select("doc_id", "text_key", F.explode("runs").alias("run"))
            .select(F.col("run.mark").alias("mark"), F.col("run.r1").alias("r1"),
                    F.col("run.r2").alias("r2"), place.alias("place"),
                    F.col("run.stop").alias("stop"))
            .join(repeated, "mark", "left_semi").drop("mark"))
    near = materialize(near, "positions")
    # Written down, so that the join below shuffles both sides for itself and Spark can split the
    # occurrences of a very common run among tasks.
    first = materialize(
        near.groupBy("r1", "r2").agg(F.min("place").alias("first"), F.max("place").alias("last"))
        .filter("first < last").drop("last"), "first")
    later = near.join(first, ["r1", "r2"]).filter("place > first")
    return (later.groupBy("place.doc_id", "place.text_key")
            .agg(F.array_sort(F.collect_set(F.struct(F.col("place.start").alias("start"), "stop")))
                 .alias("spans")))


def _remove(texts: pa.StringArray, spans: pa.ListArray) -> list:
    kept, n_lines, n_removed = [], [], []
    for text, gone in zip(texts.to_pylist(), spans.to_pylist()):
        if text is None:
            kept.append(None)
            n_lines.append(0)
            n_removed.append(0)
            continue
        lines = text.split("\n")
        # Spans overlap, so their ends are counted instead of their lines.
        depth = np.zeros(len(lines) + 1, np.int64)
        for span in gone or ():
            depth[span["start"]] += 1
            depth[span["stop"] + 1] -= 1
        drop = np.cumsum(depth[:-1]) > 0
        n_lines.append(len(lines))
        n_removed.append(int(drop.sum()))
        kept.append("\n".join(line for line, d in zip(lines, drop.tolist()) if not d)
                    if n_removed[-1] else text)
    return [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()),
            pa.array(n_removed, pa.int64())]


def remove_repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                         min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their columns, the lines of later occurrences taken out of the text, and
    `n_lines` (before) and `n_removed`. Columns of these names in `docs` are replaced.

    Texts are moved once, to be joined with their spans.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    spans = repeated_runs(docs, doc_id, text, min_words).select(
        F.col("doc_id").alias("_span_id"), F.col("text_key").alias("_span_key"), "spans")
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
                        F.col(f"`{doc_id}`").alias("_id"), text_key(text).alias("_key"))
    marked = keyed.join(spans, keyed["_id"].eqNullSafe(spans["_span_id"])
                        & (keyed["_key"] == spans["_span_key"]), "left").select(
        *[f"c{i}" for i in range(len(names))], "spans")
    at = names.index(text)
    schema = marked.drop("spans").schema.add("n_lines", T.LongType()).add(
        "n_removed", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(names))]
            done = _remove(columns[at].cast(pa.string()), batch.column(len(names)))
            columns[at] = done[0]
            yield pa.RecordBatch.from_arrays([*columns, *done[1:]], names=schema.names)

    return marked.mapInArrow(run, schema).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "n_lines", "n_removed")
