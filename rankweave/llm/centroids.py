"""Exact centroid clustering that skips most distances by Ns-bounds.

Lloyd's rounds over integer vectors: every vector goes to its nearest centroid (ties: the smaller
number), then every centroid that has vectors becomes the floor of their mean. The result is that
of computing all distances in all rounds.

With each vector stands, for every centroid, the distance as it was when last computed and the round
of that. The history of all centroids is kept, a few numbers a round. In a later round a stored
distance holds as a bound once it is loosened by the distance between the centroid's place then and
its place now: the norm of the total displacement, never more than the sum of the moves in between.
If the loosened upper bound of the vector's own centroid lies below the loosened lower bounds of all
others, nothing is computed. Otherwise the own distance is computed, and then those that may still
be smaller, in whole numbers. Bounds are floating-point numbers with a margin and only decide what
is computed.

A round is one map step over the vectors with their bounds. It writes them anew to the shared
folder, with the sums and counts of the clusters in each task as a few rows of their own, which Spark
adds up; the folder of the round before is then removed. Nothing is shuffled but those sums, so a
cluster with almost all vectors is spread like any other.

Defined cases: vectors of another width, null ones and those with a null or non-finite component are
left out. Vectors with a null id are clustered but are first centroids only if there are too few
others. Repeated rows count each. With fewer vectors than centroids there are fewer centroids; an
empty table gives no rows. Components beyond 2^17 are an error, since squared distances would not
fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import discard, materialize, scratch_dir

SCALE = 1024
MOST = 1 << 27          # of a component, so that squares add up within 64 bits
MARGIN = 1e-9           # relative, for the rounding of bounds
STEP_ROWS = 8192        # vectors a task works on at a time


@dataclass
class History:
    """The centroids of every round so far, and how far each has moved since each round."""

    rounds: list[np.ndarray] = field(default_factory=list)
    # moved[t, j]: distance between centroid j in round t and now
    moved: np.ndarray | None = None

    def add(self, centroids: np.ndarray) -> None:
        self.rounds.append(centroids)
        then = np.stack(self.rounds).astype(float)
        self.moved = np.sqrt(((then - centroids) ** 2).sum(axis=2))

    @property
    def now(self) -> np.ndarray:
        return self.rounds[-1]


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def kept_vectors(vectors: DataFrame, vec_id: str, embedding: str, width: int,
                 scale: int = SCALE) -> DataFrame:
    """`vec_id` and `x`, the components as whole numbers, of the vectors that can be clustered."""
    column = F.col(f"`{embedding}`")
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), column.alias("_v")).filter(
        column.isNotNull() & (F.size(column) == width) & F.coalesce(finite, F.lit(False)))
    small = F.transform(whole_numbers(F.col("_v"), scale), lambda x: F.when(
        F.abs(x) <= MOST, x.cast("int")).otherwise(
        F.raise_error(F.lit("a component is too large to be clustered")).cast("int")))
    return rows.select("vec_id", small.alias("x"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the smallest SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = kept.select(digest.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k)
    return np.array([r["x"] for r in chosen.collect()], np.int64)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each vector to the centroid on its row, exact."""
    gap = x - centroids
    return np.einsum("ij,ij->i", gap, gap)


def assign(x: np.ndarray, cluster: np.ndarray, known: np.ndarray, since: np.ndarray,
           history: History) -> int:
    """Give each vector its nearest centroid, in place; how many distances were computed.

    `known[i, j]` is the distance of vector i to centroid j as of round `since[i, j]`; a cluster of
    -1 has none yet.
    """
    centroids, now = history.now, len(history.rounds) - 1
    k = len(centroids)
    columns = np.arange(k)
    loose = history.moved[since, columns]
    low = (known - loose) * (1 - MARGIN) - MARGIN
    rows = np.arange(len(x))
    fresh = cluster < 0
    own = np.where(fresh, 0, cluster)
    low[rows, own] = np.inf
    high = (known[rows, own] + loose[rows, own]) * (1 + MARGIN) + MARGIN
    low[fresh], high[fresh] = -np.inf, np.inf
    failed = np.flatnonzero(high >= low.min(axis=1))
    if not len(failed):
        return 0
    # The own distance first; what is still closer by its bound is computed as well.
    best, best_d = own[failed].copy(), squared(x[failed], centroids[own[failed]])
    known[failed, best], since[failed, best] = np.sqrt(best_d), now
    high = known[failed, best] * (1 + MARGIN) + MARGIN
    computed = len(failed)
    start = best.copy()
    for j in columns:
        at = np.flatnonzero((low[failed, j] <= high) & (start != j))
        if not len(at):
            continue
        d = squared(x[failed[at]], centroids[j])
        computed += len(at)
        known[failed[at], j], since[failed[at], j] = np.sqrt(d), now
        better = (d < best_d[at]) | ((d == best_d[at]) & (j < best[at]))
        best[at[better]], best_d[at[better]] = j, d[better]
    cluster[failed] = best
    return computed


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = matrix.shape
    ends = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(matrix.ravel(), kind))


STATE = "x array<int>, cluster int, known array<double>, since array<int>"
SUMS = "sums array<bigint>, n bigint, computed bigint"


def _round(history: History):
    """Assign the vectors of a task; the last rows are its sums by cluster (`part` 1)."""
    k, width = history.now.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        computed, names, kind = 0, None, None
        for whole in batches:
            kind = whole.schema.field(0).type
            for start in range(0, whole.num_rows, STEP_ROWS):
                batch = whole.slice(start, STEP_ROWS)
                x = _matrix(batch.column(1), np.int64)
                cluster = batch.column(2).to_numpy(zero_copy_only=False).copy()
                known, since = _matrix(batch.column(3), float), _matrix(batch.column(4), np.int64)
                computed += assign(x, cluster, known, since, history)
                for j in range(k):
                    mine = cluster == j
                    sums[j] += x[mine].sum(axis=0)
                    counts[j] += mine.sum()
                n = len(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(cluster, pa.int32()),
                     _lists(known, pa.float64()), _lists(since, pa.int32()),
                     pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64()),
                     pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int32))], names=NAMES)
        if kind is None:
            return
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, kind), pa.nulls(k, pa.list_(pa.int32())), pa.array(range(k), pa.int32()),
             pa.nulls(k, pa.list_(pa.float64())), pa.nulls(k, pa.list_(pa.int32())),
             _lists(sums, pa.int64()), pa.array(counts),
             pa.array([computed] + [0] * (k - 1), pa.int64()), pa.array([1] * k, pa.int32())],
            names=NAMES)

    return run


NAMES = ["vec_id", "x", "cluster", "known", "since", "sums", "n", "computed", "part"]


@dataclass
class Clustering:
    """`state` has `vec_id`, `x`, `cluster`; `centroids` the last ones; `computed` the number of
    distances computed in each round."""

    state: DataFrame
    centroids: np.ndarray
    computed: list[int]


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64,
                    seed: int = 3, vec_id: str = "vec_id",
                    embedding: str = "embedding") -> Clustering:
    """Run `rounds` rounds from the first centroids and assign every vector once more."""
    spark = vectors.sparkSession
    kept = materialize(kept_vectors(vectors, vec_id, embedding, width), "vectors")
    history = History()
    first = first_centroids(kept, k, seed)
    id_type = kept.schema["vec_id"].dataType.simpleString()
    if not len(first):
        return Clustering(kept.select("vec_id", "x", F.lit(0).alias("cluster")),
                          np.zeros((0, width), np.int64), [])
    history.add(first)
    k = len(first)
    state = kept.withColumns({
        "cluster": F.lit(-1), "known": F.array_repeat(F.lit(0.0), k),
        "since": F.array_repeat(F.lit(0), k)})
    schema = f"vec_id {id_type}, {STATE}, {SUMS}, part int"
    before, computed = kept, []
    for turn in range(rounds + 1):
        path = scratch_dir(spark, "round")
        state.mapInArrow(_round(history), schema).write.parquet(path)
        done = spark.read.schema(schema).parquet(path)
        discard(before)
        before = done
        state = done.filter("part = 0").select("vec_id", "x", "cluster", "known", "since")
        totals = done.filter("part = 1").groupBy("cluster").agg(
            F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"),
            F.sum("n").alias("n"), F.sum("computed").alias("computed")).collect()
        computed.append(sum(r["computed"] for r in totals))
        if turn < rounds:
            centroids = history.now.copy()
            for r in totals:
                if r["n"]:
                    centroids[r["cluster"]] = [s // r["n"] for s in r["sums"]]
            history.add(centroids)
    return Clustering(state.select("vec_id", "x", "cluster"), history.now, computed)


def summary(found: Clustering) -> DataFrame:
    """`vec_id`, `cluster`, `distance` (squared), `cluster_inertia`, `inertia`, `centroid_sha256`
    of every vector."""
    spark = found.state.sparkSession
    schema = "cluster int, centroid array<bigint>, centroid_sha256 string"
    told = spark.createDataFrame(
        [(j, c.tolist(), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
         for j, c in enumerate(found.centroids)], schema)
    # As many rows as there are centroids.
    far = F.aggregate(F.zip_with("x", "centroid", lambda a, b: (a - b) * (a - b)),
                      F.lit(0).cast("bigint"), lambda s, d: s + d)
    rows = found.state.join(F.broadcast(told), "cluster").select(
        "vec_id", "cluster", far.alias("distance"), "centroid_sha256")
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    sums = sums.crossJoin(F.broadcast(total))  # one row
    return rows.join(F.broadcast(sums), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
