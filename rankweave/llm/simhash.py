"""Near-duplicates by SimHash with bit-sliced comparison.

Each text gets a 64-bit fingerprint: the majority of the bits of the hashes of its word shingles.
Fingerprints that differ in three bits or fewer are linked, and linked ones form components.

Equal fingerprints are merged first, so a group of copies is one entry however large it is. Two
fingerprints that differ in three bits agree in one of any four parts of their bits, and in one of
four parts of the rest, and so on; each entry is sent to the 16 buckets named by 28 agreeing bits.
A bucket with very many entries is parted again by 16 more agreeing bits, by the same argument, so
no bucket has to be cut short. Inside a bucket 64 entries stand side by side: bit plane k holds bit
k of each, one machine word updates 64 distances with a carry-save counter, and a block is abandoned
once the counters of all its entries have run over. A bucket emits a link from each entry to the
first of its component there, never all pairs. Components are then joined by rounds of large and
small stars over the links, each written to the shared folder.

Defined cases: a null or empty text has the fingerprint 0 and is linked like any other. Repeated
rows get the same result. Rows with a null id have a fingerprint and a component, whose id is null
only if all its rows have none. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import discard, materialize
from .common import per_text, raw_texts, text_key

SHINGLE = 3
SEED = 42
RADIUS = 3                  # counters of two bits count to three
BUCKET_ENTRIES = 4096       # larger buckets are parted again
TASK_ROWS = 50_000          # of the tables between the steps, by task: at least ...
FILE_ROWS = 5_000_000       # ... and about
STEP_PAIRS = 1 << 13        # comparisons of an entry with a block at a time


def _bit_weights() -> np.ndarray:
    """Row v: the eight bits of the byte v, highest first."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


_BITS = _bit_weights()
_LANE = np.arange(8) * 256


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Unsigned. Lower-cases A-Z only; words stand between ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - size + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])[:n].tolist()
    ends = np.concatenate([gaps, [len(joined)]])[size - 1:].tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends)]),
                           np.uint8).reshape(n, 8)
    # How often each byte value stands at each place, and with that how often each bit is set.
    seen = np.bincount((hashes + _LANE).ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (seen @ _BITS) > n).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def _fingerprints(size: int):
    def run(texts: pa.StringArray) -> list:
        found = np.array([fingerprint(t, size) for t in raw_texts(texts)], np.uint64)
        return [pa.array(found.view(np.int64))]
    return lambda: run


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text",
                 size: int = SHINGLE) -> DataFrame:
    """The `keep` columns and `fp`, the fingerprint as a signed 64-bit integer."""
    return per_text(docs, keep, text, _fingerprints(size), "fp bigint")


def _parts(mask: int) -> list[int]:
    """`mask` with one of four parts of the bits it leaves open, in four ways."""
    rest = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(rest) * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return [mask | sum(1 << b for b in rest[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def masks(mask: int = 0, levels: int = 2) -> list[int]:
    """Sets of agreeing bits; a pair within the radius agrees on one of them."""
    found = [mask]
    for _ in range(levels):
        found = [x for m in found for x in _parts(m)]
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _explode_masks(found: list[int]):
    return F.explode(F.array(*[F.lit(_signed(m)).cast("bigint") for m in found]))


def buckets(fps: DataFrame, limit: int = BUCKET_ENTRIES) -> DataFrame:
    """`(mask, value, fp)`: each fingerprint in every bucket in which it may have neighbours."""
    value = F.col("fp").bitwiseAND(F.col("mask"))
    wide = fps.select("fp", _explode_masks(masks()).alias("mask")).select("mask", value.alias(
        "value"), "fp")
    sizes = wide.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = wide.join(sizes, ["mask", "value"])
    deeper = F.create_map(*[x for m in masks() for x in (
        F.lit(_signed(m)).cast("bigint"),
        F.array(*[F.lit(_signed(d)).cast("bigint") for d in masks(m, 2)]))])
    return (shared.select("fp", F.explode(
        F.when(F.col("n") > limit, F.element_at(deeper, F.col("mask")))
        .otherwise(F.array("mask"))).alias("mask"))
        .select("mask", value.alias("value"), "fp"))


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of unsigned fingerprints: row k, word b holds bit k of entries 64 b to 64 b + 63,
    the first entry lowest."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[:len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _compare(plane: np.ndarray, fps: np.ndarray, who: np.ndarray, block: np.ndarray,
             valid: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (entry, entry of the block) within the radius, for entries set against whole blocks.

    `valid` has a bit for each entry of the block that counts. Two bits of each distance and a bit
    for having run over are kept as words, one bit of each of the 64 distances in a word.
    """
    ones = np.zeros_like(valid)
    twos = np.zeros_like(valid)
    over = np.zeros_like(valid)
    for k in range(64):
        differs = plane[k][block] ^ (np.uint64(0) - (fps[who] >> np.uint64(k) & np.uint64(1)))
        carry = ones & differs
        ones ^= differs
        over |= twos & carry
        twos ^= carry
        if k % 8 == 7:
            alive = np.flatnonzero(valid & ~over)
            if len(alive) < len(who):  # abandon blocks all of whose entries are too far
                who, block, valid = who[alive], block[alive], valid[alive]
                ones, twos, over = ones[alive], twos[alive], over[alive]
            if not len(alive):
                return
    near = valid & ~over
    bits = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(bits)
    yield who[at], block[at] * 64 + lane


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a and b pair by pair; `parent` stays flat, the least entry leads."""
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        open_ = low < high
        if not open_.any():
            return
        np.minimum.at(parent, high[open_], low[open_])
        while not np.array_equal(parent, parent[parent]):
            parent[:] = parent[parent]


def bucket_links(bucket: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of the same bucket, from each to the first of its component.

    `bucket` numbers the buckets in ascending order; a bucket's entries stand together.
    """
    n = len(fps)
    parent = np.arange(n)
    end = np.searchsorted(bucket, bucket, side="right")
    plane = planes(fps)
    first, last = np.arange(n) // 64, (end - 1) // 64
    start = 0
    while start < n:
        # Entries whose blocks make up one step.
        total = np.cumsum(last[start:start + STEP_PAIRS] - first[start:start + STEP_PAIRS] + 1)
        stop = start + max(1, int(np.searchsorted(total, STEP_PAIRS, side="right")))
        entry = np.arange(start, min(stop, n))
        # Blocks that are one class as a whole need no comparison with entries of that class.
        edges = np.arange(0, n, 64)
        low, high = np.minimum.reduceat(parent, edges), np.maximum.reduceat(parent, edges)
        for who, block in _pairs(entry, first, last):
            open_ = (low[block] != high[block]) | (low[block] != parent[who])
            who, block = who[open_], block[open_]
            lo = np.maximum(who + 1 - block * 64, 0)
            hi = np.minimum(end[who] - block * 64, 64)
            for a, b in _compare(plane, fps, who, block, _range_bits(lo, hi)):
                _unite(parent, a, b)
        start = stop
    moved = np.flatnonzero(parent != np.arange(n))
    return fps[moved], fps[parent[moved]]


def _pairs(entry: np.ndarray, first: np.ndarray, last: np.ndarray):
    """(entry, block) for every block that an entry meets, in steps of bounded size."""
    counts = last[entry] - first[entry] + 1
    if len(entry) == 1:
        blocks = np.arange(first[entry[0]], last[entry[0]] + 1)
        for i in range(0, len(blocks), STEP_PAIRS):
            part = blocks[i:i + STEP_PAIRS]
            yield np.full(len(part), entry[0]), part
        return
    who = np.repeat(entry, counts)
    within = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
    yield who, first[who] + within


def _range_bits(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Words with the bits from lo to before hi set."""
    one, full = np.uint64(1), ~np.uint64(0)

    def below(x):
        x = np.clip(x, 0, 64).astype(np.uint64)
        return np.where(x >= 64, full, (one << (x & np.uint64(63))) - one)
    return below(hi) & ~below(lo)


def _link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; a bucket's rows may come in several batches."""
    held: list[np.ndarray] = []
    rows = 0

    def links(table: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(table), bool)
        new[1:] = (table[1:, :2] != table[:-1, :2]).any(axis=1)
        a, b = bucket_links(np.cumsum(new), np.ascontiguousarray(table[:, 2]).view(np.uint64))
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        same = (table[:, :2] == table[-1, :2]).all(axis=1)
        keep = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if keep:  # everything before the last bucket is whole
            yield links(np.concatenate([*held, table[:keep]]))
            held = [table[keep:]]
        elif held and (held[-1][-1, :2] != table[0, :2]).any():
            yield links(np.concatenate(held))
            held = [table]
        else:
            held.append(table)
    if held:
        yield links(np.concatenate(held))


def links(fps: DataFrame, limit: int = BUCKET_ENTRIES) -> DataFrame:
    """`(a, b)` links that connect all distinct fingerprints `fp` within the radius."""
    sorted_rows = buckets(fps, limit).repartition("mask", "value").sortWithinPartitions(
        "mask", "value", "fp")
    return sorted_rows.mapInArrow(_link_rows, "a bigint, b bigint").distinct()


def _tasks(spark: SparkSession, rows: int) -> int:
    """How many tasks, and so files, a narrow table of so many rows is written by: small tables by
    few, large ones by enough for all cores, in files of some millions of rows."""
    cores = spark.sparkContext.defaultParallelism
    return 1 + min(rows // TASK_ROWS, max(2 * cores, rows // FILE_ROWS))


def components(edges: DataFrame, tasks: int = 1) -> DataFrame:
    """`(node, root)` of every node of the links; the root is the least node of the component.

    In a large star every larger neighbour of a node is linked to the least neighbour, in a small
    star every smaller one. Both leave the components as they are, and after some rounds only stars
    are left. Minima are taken in the map tasks first; each round is written to the shared folder,
    by as many tasks as its links need.
    """
    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def round_of(now: DataFrame) -> DataFrame:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        down = (both.filter("v > u").join(least(both), "u")
                .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        low = least(down)
        return (down.join(low, "u").filter("v > m").select(F.col("v").alias("a"),
                                                           F.col("m").alias("b"))
                .unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())

    def mark(pairs: DataFrame):
        return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    # a is the larger end.
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .filter("a > b").distinct().coalesce(tasks), "links")
    before, after = None, mark(now)
    while after[0] and after != before:
        last, now = now, materialize(
            round_of(now).coalesce(_tasks(now.sparkSession, after[0])), "stars")
        before, after = after, mark(now)
        discard(last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def classes(found: DataFrame, order: list[str]) -> DataFrame:
    """`fp`, `root`, `least`: for each distinct fingerprint of `found` its component, named by a
    fingerprint, and the least row of the component by the columns `order`."""
    key = F.struct(*order)
    tasks = _tasks(found.sparkSession, found.count())
    distinct = materialize(
        found.groupBy("fp").agg(F.min(key).alias("least")).coalesce(tasks), "distinct")
    labels = components(links(distinct.select("fp")), tasks)
    rooted = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least")
    # Most components are one fingerprint; the rest are combined in the map tasks.
    best = rooted.groupBy("root").agg(F.min("least").alias("least"))
    return rooted.drop("least").join(best, "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    size: int = SHINGLE) -> DataFrame:
    """`doc_id`, `fp` and `component_id`, the least id of the component, for every document."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = materialize(fingerprints(rows, ["doc_id"], size=size), "fingerprints")
    missing = found.withColumn("missing", F.col("doc_id").isNull())
    label = classes(missing, ["missing", "doc_id"]).select(
        "fp", F.col("least.doc_id").alias("component_id"))
    return found.join(label, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                size: int = SHINGLE) -> DataFrame:
    """The documents with the least id of their component, with their columns; of repeated rows one.

    Rows of one id are told apart by a hash of their text. Texts are moved once, to be joined with
    the rows that stay.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_key(text).alias("text_key"),
                       F.col(f"`{text}`").alias("text"))
    found = materialize(fingerprints(rows, ["doc_id", "text_key"], size=size), "fingerprints")
    best = classes(found.withColumn("missing", F.col("doc_id").isNull()),
                   ["missing", "doc_id", "text_key"])
    return keep_least(docs, best, doc_id, text)


def keep_least(docs: DataFrame, best: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The documents that are the `least` of a component in `best`, one of repeated rows."""
    key = text_key(text)
    stay = best.select("least.doc_id", "least.text_key").distinct().select(
        F.col("doc_id").alias("_stay_id"), F.col("text_key").alias("_stay_key"))
    names = docs.columns
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
                        F.col(f"`{doc_id}`").alias("_id"), key.alias("_key"))
    kept = keyed.join(stay, keyed["_id"].eqNullSafe(stay["_stay_id"])
                      & (keyed["_key"] == stay["_stay_key"]), "left_semi")
    return kept.dropDuplicates(["_id", "_key"]).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
