"""Packing documents into sequences of fixed length with a controlled mixture of sources.

Documents wait in one queue for each source. Every sequence is filled from all queues by deficit
round-robin: as tokens are given out, each queue is owed its target share of them, the next token
comes from the queue whose next one is longest due, and what a queue is owed or ahead (its deficit,
under one token but for rounding) is carried into the next sequence. A token is due at the middle of
its turn: token i of a queue with target rate r at time (i + 1/2) / r, ties by queue. So what each
queue has given after any number of tokens follows from the queues' totals alone, by a few steps of
the round-robin around the even share, and every task takes up the deficits at its own place without
waiting for others. Within a sequence each queue's tokens stand together. Documents are cut where a
sequence's share of their queue ends.

A queue is in the order in which its documents were encoded: task by task, and row by row in a task.
The tasks' totals by queue, summed up, give each document its place, so neither texts nor ids are
shuffled. All sequences are full but for the last tokens, fewer than a sequence has, which are cut
into sequences of powers of two: nothing is padded. Targets are by default the sources' shares of
all tokens, so that every sequence has the mixture of the whole; with other targets a queue that
runs dry leaves its share to the others.

Sources with less than `LEAST_SHARE` of the bytes wait in a common queue, so there are few queues
however many sources there are, and a sequence has few pieces.

Defined cases: a null or empty text is the end id alone, a null source is a source. Repeated rows
are packed each. An empty table gives no pieces. A very long text is cut into as many pieces as it needs; a task holds its text and ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import lookup_join, materialize
from . import byte_bpe
from .common import as_texts, slices, text_bytes

LENGTH = 2048
END_ID = 1
LEAST_SHARE = 1 / 128
QUEUES = 256            # more than there can be; parts are numbered in steps of it


def _powers(rest: int) -> list[int]:
    """Powers of two that add up to `rest`, largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Schedule:
    """Which tokens of which queue go into which sequence; all of it follows from the totals."""

    def __init__(self, totals: list[int], rates: list[float] | None = None, length: int = LENGTH):
        self.totals = np.array(totals, np.int64)
        self.rates = np.array(rates if rates is not None else totals, float)
        self.length, self.all = length, int(self.totals.sum())
        self.full = self.all // length
        tails = _powers(self.all % length)
        self.tails = self.full * length + np.concatenate([[0], np.cumsum(tails)]).astype(np.int64)
        self.sequences = self.full + len(tails)
        # Tokens given out by a time grow evenly between the times at which queues run dry.
        with np.errstate(divide="ignore", invalid="ignore"):
            dry = np.where(self.totals > 0, self.totals / self.rates, 0)
        self.times = np.unique(np.concatenate([[0.0], dry]))
        self.by_time = np.minimum(self.totals, np.outer(self.times, self.rates)).sum(axis=1)

    def position(self, sequence: np.ndarray) -> np.ndarray:
        """Tokens before each sequence."""
        late = np.clip(sequence - self.full, 0, len(self.tails) - 1)
        return np.where(sequence <= self.full, sequence * self.length, self.tails[late])

    def given(self, at: np.ndarray) -> np.ndarray:
        """(place, queue): tokens that each queue has given after `at` tokens in all."""
        totals, rates = self.totals, self.rates
        time = np.interp(at, self.by_time, self.times)
        out = np.clip(np.floor(np.outer(time, rates) + 0.5), 0, totals).astype(np.int64)
        going = np.arange(len(at))
        while len(going):
            now = out[going]
            with np.errstate(divide="ignore", invalid="ignore"):
                due = np.where(now < totals, (now + 0.5) / rates, np.inf)
                last = np.where(now > 0, (now - 0.5) / rates, -np.inf)
            row = np.arange(len(going))
            serve, back = due.argmin(axis=1), len(totals) - 1 - last[:, ::-1].argmax(axis=1)
            owed = at[going] - now.sum(axis=1)
            # A token given out before one that was due earlier goes back for it.
            early = (last[row, back] > due[row, serve]) | (
                (last[row, back] == due[row, serve]) & (back > serve))
            more, less = (owed > 0) | ((owed == 0) & early), owed < 0
            out[going[more], serve[more]] += 1
            out[going[less], back[less]] -= 1
            going = going[more | less]
        return out

    def deficits(self, at: np.ndarray) -> np.ndarray:
        """What each queue is owed after `at` tokens, while no queue has run dry."""
        return np.outer(at, self.rates / self.rates.sum()) - self.given(at)

    def _reach(self, queue: int, first: int, stop: int) -> tuple[int, int]:
        """Sequences among which the tokens of a queue from `first` to before `stop` must lie."""
        rate = self.rates[queue]
        at = np.interp([(first + 0.5) / rate, (stop - 0.5) / rate], self.times, self.by_time)
        slack = len(self.totals) + 1
        low = max(0, int(at[0] - slack) // self.length - 1)
        high = int(at[1] + slack) // self.length + 2
        if high >= self.full:
            high = self.sequences
        return min(low, max(0, self.full - 1)), high

    def pieces(self, queue: int, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of documents that follow one another in a queue: (document, start in it, length,
        sequence, offset there)."""
        stop = int(first[-1] + size[-1])
        low, high = self._reach(queue, int(first[0]), stop)
        given = self.given(self.position(np.arange(low, high + 1)))
        mine = given[:, queue]
        before = np.diff(given[:, :queue].sum(axis=1))  # in the sequence, of the queues before
        inside = mine[(mine > first[0]) & (mine < stop)]
        cuts = np.unique(np.concatenate([first, inside]))
        length = np.diff(np.append(cuts, stop))
        owner = np.searchsorted(first, cuts, side="right") - 1
        window = np.searchsorted(mine, cuts, side="right") - 1
        return (owner, cuts - first[owner], length, low + window,
                before[window] + cuts - mine[window])


def queue_names(docs: DataFrame, source: str, text: str) -> list[str | None]:
    """The sources with a queue of their own, at most 1 / LEAST_SHARE of them."""
    size = F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("long") + 1
    sums = docs.groupBy(F.col(f"`{source}`").cast("string").alias("source")).agg(
        F.sum(size).alias("size"))
    sums = materialize(sums, "sources")
    least = (sums.agg(F.sum("size").alias("n")).first()["n"] or 0) * LEAST_SHARE
    large = [r["source"] for r in sums.filter(F.col("size") >= least).collect()]
    return sorted(large, key=lambda name: (name is None, name or ""))


def _encode(path: str, end_id: int, queue_of: dict[str | None, int]):
    common = len(queue_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_bpe.encoder(path)
        seen = np.zeros(common + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            texts = as_texts(batch.column(2))
            for start, stop in slices(texts):
                ids, ends = table.encode(texts.slice(start, stop - start), end_id)
                size = np.diff(ends)
                places = pa.array((ends * ids.itemsize).astype(np.int32))
                packed = pa.Array.from_buffers(pa.binary(), len(size), [
                    None, places.buffers()[1], pa.py_buffer(ids.tobytes())])
                queue = np.array([queue_of.get(s, common) for s in
                                  batch.column(1).slice(start, stop - start).to_pylist()])
                first = np.empty(len(size), np.int64)
                for q in np.unique(queue):
                    mine = queue == q
                    upto = np.cumsum(size[mine])
                    first[mine] = seen[q] + upto - size[mine]
                    seen[q] += upto[-1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start),
                     pa.array(part * QUEUES + queue, pa.int64()), pa.array(first),
                     pa.array(size), packed],
                    names=["doc_id", "slot", "first", "doc_tokens", "ids"])

    return run


def _cut(schedule: Schedule, dtype: np.dtype, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, stop in slices(whole.column(3)):
                yield cut(whole.slice(start, stop - start))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        slot, first, size = (batch.column(i).to_numpy() for i in (1, 4, 2))
        raw, places = text_bytes(batch.column(3))
        values = raw.view(dtype).astype("<u4")
        ends = places // dtype.itemsize
        found = [[] for _ in range(5)]
        # Rows of a slot follow one another in its queue.
        order = np.argsort(slot, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1):
            got = schedule.pieces(int(slot[rows[0]] % QUEUES), first[rows], size[rows])
            for column, x in zip(found, (rows[got[0]], *got[1:])):
                column.append(x)
        row, begin, length, sequence, offset = (np.concatenate(x) for x in found)
        at = ends[row] + begin
        view = memoryview(values.view(np.uint8))
        spans = zip((4 * at).tolist(), (4 * (at + length)).tolist())
        columns = [batch.column(0).take(pa.array(row)), pa.array(begin), pa.array(length),
                   pa.array([zlib.crc32(view[a:b]) for a, b in spans], pa.int64()),
                   pa.array(size[row]), pa.array(sequence), pa.array(offset),
                   pa.array(slot[row] % QUEUES, pa.int32())]
        if with_ids:
            columns.append(pa.array([values[a:a + n].astype(np.int64)
                                     for a, n in zip(at, length)], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, names=NAMES[:len(columns)])

    return run


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue",
         "ids"]


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text",
         source: str = "source", target: dict[str | None, float] | None = None,
         length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces: `doc_id`, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset`,
    `queue`, and with `with_ids` the `ids`.

    `target` gives the wanted shares of the sources; those it does not name have weight 0.001 of the
    least named and so come last. By default the sources' own shares of the tokens are the target.
    """
    names = queue_names(docs, source, text) if docs.columns else []
    if target is not None:
        names = sorted(set(names) | set(target), key=lambda name: (name is None, name or ""))
    if len(names) >= QUEUES:
        raise ValueError(f"fewer than {QUEUES} sources can have a target")
    queue_of = {name: i for i, name in enumerate(names)}
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"),
                       F.col(f"`{source}`").cast("string").alias("source"),
                       F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    encoded = materialize(rows.mapInArrow(
        _encode(vocabulary, end_id, queue_of),
        f"doc_id {kind}, slot bigint, first bigint, doc_tokens bigint, ids binary"), "ids")
    parts = encoded.groupBy("slot").agg(F.sum("doc_tokens").alias("n")).withColumn(
        "queue", (F.col("slot") % QUEUES).cast("int"))
    # One row for each encoding task and queue.
    before = Window.partitionBy("queue").orderBy("slot").rowsBetween(
        Window.unboundedPreceding, -1)
    parts = materialize(parts.withColumn(
        "before", F.coalesce(F.sum("n").over(before), F.lit(0))), "parts")
    totals = np.zeros(len(names) + 1, np.int64)
    for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect():
        totals[r["queue"]] = r["n"]
    schedule = Schedule(totals.tolist(), _rates(names, target), length)
    placed = lookup_join(encoded, parts.select("slot", "before"), "slot").select(
        "doc_id", "slot", "doc_tokens", "ids", (F.col("first") + F.col("before")).alias("first"))
    schema = (f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
              "sequence_id bigint, offset bigint, queue int")
    dtype = byte_bpe.encoder(vocabulary).dtype
    return placed.mapInArrow(_cut(schedule, dtype, with_ids),
                             schema + (", ids array<bigint>" if with_ids else ""))


def _rates(names: list[str | None], target: dict[str | None, float] | None) -> list[float] | None:
    if target is None:
        return None
    if not target or min(target.values()) <= 0:
        raise ValueError("targets must be above 0")
    least = min(target.values()) / 1000
    return [*(target.get(name, least) for name in names), least]


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """`sequence_id` and `ids`, the whole sequences, of pieces packed with their ids.

    A sequence has `length` ids at most, so no group is large.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(
        F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
