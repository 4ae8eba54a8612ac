"""Exact and approximate nearest neighbours by cosine similarity.

Documents are scanned once in Arrow batches; a batch is scored against all queries by one matrix
product, and a task sends on at most `k` rows per query. The final cut is a Spark window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import scoring
from ..functions.vectors import norm
from ..session import BROADCAST_BYTES, materialize, measured, scan_tasks, split, union_all
from . import topk

# Scores held at once by a task: this many doubles.
BLOCK_SCORES = 4_000_000

# Results held by a task: queries of a part times the documents wanted for each.
PART_RESULTS = 4_000_000
EMIT_ROWS = 100_000

# Rounding moves a score by less than this.
MARGIN = 10.0 ** -scoring.VECTOR_DIGITS


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows with a vector that has a direction: not null, not empty, not zero."""
    return vectors.filter(F.col(column).isNotNull()).filter(norm(F.col(column)) > 0)


def present(vectors: DataFrame) -> DataFrame:
    """Rows with a vector; those without direction are found by the scan itself."""
    return vectors.filter(F.col("embedding").isNotNull())


def _directed(batch: pa.RecordBatch, dims: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows of a batch whose vector (column 1) has a direction, and their unit vectors."""
    matrix = _matrix(batch.column(1), dims)
    lengths = np.sqrt((matrix * matrix).sum(axis=1))
    good = np.isfinite(lengths) & (lengths > 0)
    if not good.all():
        batch, matrix, lengths = batch.filter(pa.array(good)), matrix[good], lengths[good]
    return batch, matrix / lengths[:, None]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    widths = pa.compute.list_value_length(column)
    if len(column) and (pa.compute.min(widths).as_py() != dims
                        or pa.compute.max(widths).as_py() != dims):
        raise ValueError(f"expected vectors of {dims} values")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), dims)


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _rounded(scores: np.ndarray) -> np.ndarray:
    return scoring.rounded_array(scores, scoring.VECTOR_DIGITS)


class _Best:
    """The best `k` documents of each query so far: highest score, then lowest id.

    Scores below a query's floor are dropped at once. What passes is collected, and sorted in when
    it has become as much as the rows kept, so the sorting is shared by many blocks.
    """

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.floor = np.full(n_queries, -np.inf)
        self.kept = []
        self.new = []
        self.n_new = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, which: np.ndarray | None = None) -> None:
        """`scores` is (documents, queries); `which` gives the query number of each column."""
        n = scores.shape[0]
        which = np.arange(scores.shape[1]) if which is None else which
        if n > self.k and np.isneginf(self.floor[which]).any():
            # The block alone has k documents at least this good. Ties with the k-th stay in.
            kth = np.partition(scores, n - self.k, axis=0)[n - self.k]
            self.floor[which] = np.maximum(self.floor[which], _rounded(kth))
        # Only scores that could reach the floor after rounding are rounded.
        doc, query = np.nonzero(scores >= self.floor[which] - MARGIN)
        score, query = _rounded(scores[doc, query]), which[query]
        good = score >= self.floor[query]
        self.new.append((query[good], score[good], ids[doc[good]]))
        self.n_new += int(good.sum())
        if self.n_new > max(BLOCK_SCORES // 8, len(self.kept[0]) if self.kept else 0):
            self._merge()

    def _merge(self) -> None:
        parts = ([self.kept] if self.kept else []) + self.new
        query, score, ids = (np.concatenate(columns) for columns in zip(*parts))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        keep = place < self.k
        self.kept = [query[keep], score[keep], ids[keep]]
        last = place == self.k - 1
        self.floor[query[last]] = score[last]
        self.new, self.n_new = [], 0

    def rows(self) -> list[np.ndarray]:
        if self.new:
            self._merge()
        return self.kept


def _packed(table: pa.Table) -> tuple[list, np.ndarray]:
    """Query ids and unit vectors of a part that was measured to be small."""
    if table.num_rows == 0:
        return [], np.zeros((0, 0))
    column = table.column("embedding").combine_chunks()
    dims = len(column[0])
    return table.column("query_id").to_pylist(), _unit(_matrix(column, dims))


def _schema(queries: DataFrame, documents: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("doc_id", documents.schema["doc_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def _emit(best: _Best, query_ids: list, id_type: pa.DataType,
          query_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    rows = best.rows()
    if not rows:
        return
    names = pa.array(query_ids, query_type)
    for at in range(0, len(rows[0]), EMIT_ROWS):
        query, score, ids = (column[at:at + EMIT_ROWS] for column in rows)
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(query)), pa.array(ids, id_type), pa.array(score)],
            names=["query_id", "doc_id", "score"])


def _scan(documents: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best `k` documents per query and task for one broadcast part of the queries."""
    schema = _schema(queries, documents)
    query_ids, matrix = _packed(queries.select("query_id", "embedding").toArrow())
    id_type = to_arrow_type(schema["doc_id"].dataType)
    query_type = to_arrow_type(schema["query_id"].dataType)
    shared = documents.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = shared.value
        if not len(unit):
            return
        best = _Best(len(unit), k)
        step = max(1, BLOCK_SCORES // len(unit))
        for batch in batches:
            batch, vectors = _directed(batch, unit.shape[1])
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(ids), step):
                best.add(vectors[at:at + step] @ unit.T, ids[at:at + step])
        yield from _emit(best, query_ids, id_type, query_type)

    return documents.select("doc_id", "embedding").mapInArrow(run, schema)


def vector_topk(documents: DataFrame, queries: DataFrame, top_k: int = 10,
                limit: int = BROADCAST_BYTES) -> DataFrame:
    """The nearest documents per query as `(query_id, doc_id, score, rank)`.

    `documents` holds `(doc_id, embedding)`, `queries` holds `(query_id, embedding)`; the widths
    must agree. Score is the cosine similarity. Vectors that are null or zero are left out.
    Queries beyond the broadcast limit are run in parts, with one scan of the documents per part.
    """
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    docs = present(documents)
    return _in_parts(queries, limit, lambda part: topk.top_k(
        _scan(docs, part, top_k), ["query_id"], topk.by_score(), top_k, pieces=scan_tasks(docs)),
        top_k)


def _in_parts(queries: DataFrame, limit: int, search: Callable[[DataFrame], DataFrame],
              top_k: int) -> DataFrame:
    """Search for parts of the queries that fit the limit, as do the results a task holds.

    With several parts each result is written down before the next part is taken up, so the driver
    holds the vectors of one part only.
    """
    asked = usable(queries).select("query_id", "embedding")
    rows, size = measured(asked)
    # Whichever bound asks for more parts.
    size = max(size, limit * rows * top_k // PART_RESULTS)
    parts = split(asked, ["query_id"], size, limit)
    if len(parts) == 1:
        return search(parts[0])
    return union_all([materialize(search(part)) for part in parts])


# ---- approximate search over cells -------------------------------------------------------


def train_cells(documents: DataFrame, n_cells: int, seed: int = 42,
                max_iter: int = 10) -> np.ndarray:
    """Centers of `n_cells` groups of unit vectors, by k-means over all usable documents."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from ..functions.vectors import l2_normalize

    unit = usable(documents).select(
        array_to_vector(l2_normalize(F.col("embedding"))).alias("features"))
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter).fit(unit)
    centers = np.array(model.clusterCenters())
    lengths = np.sqrt((centers * centers).sum(axis=1, keepdims=True))
    return centers / np.where(lengths == 0, 1, lengths)


def sign_cells(dims: int, bits: int) -> np.ndarray:
    """Centers of 2^bits cells that need no training and are the same for every corpus.

    Bit j of a vector's cell is the sign of its product with a direction of +1 and -1: minus at
    place i if the first hex digit of the MD5 of "j:i" is 8 or more. The center of a cell is the sum
    of the directions with the signs of its bits, so the nearest center has exactly these bits, and
    further cells follow by how far the vector lies from the planes that part them.
    """
    if not 0 < bits <= 16:
        raise ValueError("bits must be from 1 to 16")
    directions = np.array([[-1.0 if hashlib.md5(f"{j}:{i}".encode()).hexdigest()[0] >= "8" else 1.0
                            for i in range(dims)] for j in range(bits)])
    signs = np.where(np.arange(1 << bits)[:, None] >> np.arange(bits) & 1, 1.0, -1.0)
    return signs @ directions


def _blocks(vectors: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Rows in blocks whose products with `width` centers stay within the size of a block."""
    step = max(1, BLOCK_SCORES // max(1, width))
    for at in range(0, len(vectors), step):
        yield vectors[at:at + step]


def assign_cells(documents: DataFrame, centers: np.ndarray) -> DataFrame:
    """`(doc_id, embedding, cell)`: the cell whose center is nearest. A map step."""
    docs = present(documents).select("doc_id", "embedding")
    schema = T.StructType([*docs.schema.fields, T.StructField("cell", T.IntegerType())])
    shared = documents.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch, unit = _directed(batch, shared.value.shape[1])
            cells = [(block @ shared.value.T).argmax(axis=1)
                     for block in _blocks(unit, len(shared.value))]
            cell = np.concatenate(cells) if cells else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell.astype(np.int32))],
                names=["doc_id", "embedding", "cell"])

    return docs.mapInArrow(run, schema)


def probes(queries: DataFrame, centers: np.ndarray, nprobe: int) -> DataFrame:
    """`(query_id, embedding, cells)`: the `nprobe` cells nearest to each query. A map step."""
    rows = queries.select("query_id", "embedding")
    schema = T.StructType([*rows.schema.fields,
                           T.StructField("cells", T.ArrayType(T.IntegerType()))])
    shared = queries.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch, unit = _directed(batch, shared.value.shape[1])
            cells = []
            for block in _blocks(unit, len(shared.value)):
                score = block @ shared.value.T
                if nprobe < score.shape[1]:
                    score = np.argpartition(-score, nprobe - 1, axis=1)[:, :nprobe]
                else:
                    score = np.broadcast_to(np.arange(score.shape[1]), score.shape)
                cells += list(score.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.int32()))],
                names=schema.names)

    return rows.mapInArrow(run, schema)


def write_cells(assigned: DataFrame, path: str) -> DataFrame:
    """Write the cells as partitions, so that a search reads only the cells it probes.

    Rows are brought together by cell in tasks of about equal size: small cells share a task, and a
    cell that holds a third of all vectors is written by many.
    """
    assigned.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)
    return assigned.sparkSession.read.parquet(path)


def vector_ann(cells: DataFrame, centers: np.ndarray, queries: DataFrame, top_k: int = 10,
               nprobe: int = 4, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Nearest documents among the `nprobe` cells closest to each query, scored exactly.

    Same result columns as `vector_topk`; with `nprobe` equal to the number of cells the result
    is the same too.
    """
    if top_k <= 0 or nprobe <= 0:
        raise ValueError("top_k and nprobe must be positive")
    nprobe = min(nprobe, len(centers))
    spark = cells.sparkSession
    schema = _schema(queries, cells)
    id_type = to_arrow_type(schema["doc_id"].dataType)
    query_type = to_arrow_type(schema["query_id"].dataType)

    def search(part: DataFrame) -> DataFrame:
        asked = materialize(probes(part, centers, nprobe), "probes")
        # At most as many as there are cells.
        wanted = [r["c"] for r in asked.select(F.explode("cells").alias("c")).distinct().collect()]
        table = asked.toArrow()
        query_ids, matrix = _packed(table)
        nearest = (np.array(table.column("cells").to_pylist(), np.int32)
                   if query_ids else np.zeros((0, nprobe), np.int32))
        shared = spark.sparkContext.broadcast((matrix, nearest))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit, nearest = shared.value
            best = _Best(len(unit), top_k)
            for batch in batches:
                batch, vectors = _directed(batch, unit.shape[1])
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                cell = batch.column(2).to_numpy()
                for c in np.unique(cell):
                    which = np.flatnonzero((nearest == c).any(axis=1))
                    rows = np.nonzero(cell == c)[0]
                    step = max(1, BLOCK_SCORES // len(which))
                    for at in range(0, len(rows), step):
                        block = rows[at:at + step]
                        best.add(vectors[block] @ unit[which].T, ids[block], which)
            yield from _emit(best, query_ids, id_type, query_type)

        probed = cells.filter(F.col("cell").isin(wanted) if wanted else F.lit(False))
        found = probed.select("doc_id", "embedding", "cell").mapInArrow(run, schema)
        return topk.top_k(found, ["query_id"], topk.by_score(), top_k, pieces=scan_tasks(probed))

    return _in_parts(queries, limit, search, top_k)
