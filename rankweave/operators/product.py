"""Approximate nearest neighbours by product-quantized residuals and a short list scored exactly.

A vector is stored as the number of its cell and a few bytes: what the cell's center leaves of the
unit vector is cut into parts, and each part is named by the nearest of 256 learned ones. A product
with a query is then the product with the center and one table entry for each part, so a search
reads and adds up codes, a sixteenth of the bytes of 64 floats at 16 parts. The best codes of each
query are a short list, whose vectors are looked up by id and scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import scoring
from ..functions.vectors import cosine
from ..session import BROADCAST_BYTES, materialize, picked, scan_tasks
from . import topk, vector

PARTS = 16
NAMES = 256             # of each part; a code is one byte
SAMPLE = 20_000         # vectors, about, that the parts are learned from
ROUNDS = 8
SHORT = 3               # entries of the short list for each wanted result


@dataclass(frozen=True)
class ProductIndex:
    """`codes` has `doc_id`, `cell`, `code`; `vectors` has `doc_id`, `embedding`."""

    codes: DataFrame
    vectors: DataFrame
    centers: np.ndarray
    names: np.ndarray   # (parts, NAMES, width of a part)


def _residuals(unit: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell = np.concatenate([(block @ centers.T).argmax(axis=1)
                           for block in vector._blocks(unit, len(centers))] or [np.zeros(0, int)])
    return cell, unit - centers[cell]


def _nearest(rows: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The nearest name of each row, block by block."""
    half = (names * names).sum(axis=1) / 2
    return np.concatenate([(block @ names.T - half).argmax(axis=1)
                           for block in vector._blocks(rows, len(names))] or [np.zeros(0, int)])


def learn_names(documents: DataFrame, centers: np.ndarray, parts: int = PARTS,
                sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Names of the parts of residuals, by k-means over a sample.

    The sample is chosen by hash of the id, about `sample` vectors however many there are; codes are
    made for all.
    """
    docs = vector.usable(documents).select("doc_id", "embedding")
    grain = 1 << 30
    share = min(grain, grain * sample // max(1, docs.count()))
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < share).orderBy("doc_id")
    table = chosen.toArrow()
    dims = centers.shape[1]
    if dims % parts:
        raise ValueError("the width of the vectors must be a multiple of the number of parts")
    width = dims // parts
    if not table.num_rows:
        return np.zeros((parts, NAMES, width))
    unit = vector._unit(vector._matrix(table.column("embedding").combine_chunks(), dims))
    _, rest = _residuals(unit, centers)
    names = np.empty((parts, NAMES, width))
    for p in range(parts):
        rows = rest[:, p * width:(p + 1) * width]
        found = rows[np.linspace(0, len(rows) - 1, NAMES).astype(int)].copy()
        for _ in range(rounds):
            near = _nearest(rows, found)
            n = np.bincount(near, minlength=NAMES)
            sums = np.stack([np.bincount(near, rows[:, i], NAMES) for i in range(width)], axis=1)
            found[n > 0] = sums[n > 0] / n[n > 0, None]
        names[p] = found
    return names


def encode(documents: DataFrame, centers: np.ndarray, names: np.ndarray) -> DataFrame:
    """`(doc_id, cell, code)` of every vector with a direction. A map step."""
    docs = vector.present(documents).select("doc_id", "embedding")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("cell", T.IntegerType()),
                           T.StructField("code", T.BinaryType())])
    shared = documents.sparkSession.sparkContext.broadcast((centers, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, names = shared.value
        parts, _, width = names.shape
        for batch in batches:
            batch, unit = vector._directed(batch, centers.shape[1])
            cell, rest = _residuals(unit, centers)
            code = np.stack([_nearest(rest[:, p * width:(p + 1) * width], names[p])
                             for p in range(parts)], axis=1).astype(np.uint8)
            packed = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(parts), len(code), [None, pa.py_buffer(code.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cell.astype(np.int32)), packed.cast(pa.binary())],
                names=["doc_id", "cell", "code"])

    return docs.mapInArrow(run, schema)


def write_product_index(documents: DataFrame, path: str, centers: np.ndarray,
                        parts: int = PARTS, sample: int = SAMPLE) -> ProductIndex:
    """Write codes by cell, and the vectors in the order of their ids for lookups."""
    spark = documents.sparkSession
    names = learn_names(documents, centers, parts, sample)
    codes = vector.write_cells(encode(documents, centers, names), f"{path}/codes")
    (vector.present(documents).select("doc_id", "embedding").repartitionByRange("doc_id")
     .sortWithinPartitions("doc_id").write.option("parquet.bloom.filter.enabled#doc_id", "true")
     .option("parquet.block.size", str(1 << 20)).parquet(f"{path}/vectors"))
    return ProductIndex(codes, spark.read.parquet(f"{path}/vectors"), centers, names)


def product_search(index: ProductIndex, queries: DataFrame, top_k: int = 10,
                   nprobe: int | None = None, short: int = SHORT,
                   limit: int = BROADCAST_BYTES) -> DataFrame:
    """The nearest documents among the `nprobe` cells closest to each query (all by default) as
    `(query_id, doc_id, score, rank)`, of which `short * top_k` are scored exactly."""
    if top_k <= 0 or short <= 0 or (nprobe is not None and nprobe <= 0):
        raise ValueError("top_k, short and nprobe must be positive")
    nprobe = min(nprobe or len(index.centers), len(index.centers))
    parts, names, _ = index.names.shape
    # A query's table takes the room of so many vectors.
    weight = max(1, parts * names // max(1, index.centers.shape[1]))

    def search(part: DataFrame) -> DataFrame:
        listed = materialize(topk.top_k(_short_list(index, part, top_k * short, nprobe),
                                        ["query_id"], topk.by_score(), top_k * short,
                                        pieces=scan_tasks(index.codes)), "short")
        found = picked(index.vectors, "doc_id", listed).withColumnRenamed("embedding", "_d")
        asked = part.select("query_id", F.col("embedding").alias("_q"))
        pairs = listed.select("query_id", "doc_id").join(found, "doc_id").join(
            F.broadcast(asked), "query_id")  # a part is below the limit
        score = scoring.rounded(cosine(F.col("_q"), F.col("_d")), scoring.VECTOR_DIGITS)
        return topk.top_k(pairs.select("query_id", "doc_id", score.alias("score")), ["query_id"],
                          topk.by_score(), top_k)

    return vector._in_parts(queries, max(1, limit // weight), search, top_k * short)


def _short_list(index: ProductIndex, part: DataFrame, wanted: int, nprobe: int) -> DataFrame:
    """The best codes of each task and query, by table lookup."""
    spark = index.codes.sparkSession
    asked = materialize(vector.probes(part, index.centers, nprobe), "probes")
    # At most as many as there are cells.
    cells = [r["c"] for r in asked.select(F.explode("cells").alias("c")).distinct().collect()]
    table = asked.toArrow()
    query_ids, unit = vector._packed(table)
    nearest = (np.array(table.column("cells").to_pylist(), np.int32)
               if query_ids else np.zeros((0, nprobe), np.int32))
    schema = vector._schema(part, index.codes)
    id_type = to_arrow_type(schema["doc_id"].dataType)
    query_type = to_arrow_type(schema["query_id"].dataType)
    shared = spark.sparkContext.broadcast((unit, nearest, index.centers, index.names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, nearest, centers, names = shared.value
        if not len(unit):
            return
        parts, _, width = names.shape
        tables = np.stack([unit[:, p * width:(p + 1) * width] @ names[p].T
                           for p in range(parts)])  # (part, query, name)
        base = unit @ centers.T
        best = vector._Best(len(unit), wanted)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            cell = batch.column(1).to_numpy()
            code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, parts)
            for c in np.unique(cell):
                which = np.flatnonzero((nearest == c).any(axis=1))
                rows = np.flatnonzero(cell == c)
                step = max(1, vector.BLOCK_SCORES // len(which)) if len(which) else len(rows)
                for at in range(0, len(rows) if len(which) else 0, step):
                    block = rows[at:at + step]
                    score = np.repeat(base[which, c][None], len(block), axis=0)
                    for p in range(parts):
                        score += tables[p][which][:, code[block, p]].T
                    best.add(score, ids[block], which)
        yield from vector._emit(best, query_ids, id_type, query_type)

    probed = index.codes.filter(F.col("cell").isin(cells) if cells else F.lit(False))
    return probed.select("doc_id", "cell", "code").mapInArrow(run, schema)
