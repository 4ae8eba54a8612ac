"""Running all modes side by side, and runs that can be resumed."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.evaluate import build_run
from ..operators.fusion import reciprocal_rank_fusion
from ..session import materialize, path_exists, union_all
from .hybrid import Ranker, Retriever

# The names of the modes, in reporting order.
MODES = ("bm25", "vector", "rrf", "reranked")


def compare_modes(queries: DataFrame, lexical: Retriever, vector: Retriever, ranker: Ranker,
                  document: DataFrame | None = None, pool: int = 100,
                  rrf_k: int = 60) -> DataFrame:
    """One run of four modes: BM25, vector, their fusion, and the fusion reranked.

    The retrievers are expected to return `pool` results per query. The fused run is not cut; the
    ranker sees its first `pool` results.
    """
    bm25, nearest = materialize(lexical(queries)), materialize(vector(queries))
    fused = materialize(reciprocal_rank_fusion([bm25, nearest], rrf_k))
    reranked = ranker(queries, fused.filter(F.col("rank") <= pool))
    rankings = dict(zip(MODES, (bm25, nearest, fused, reranked)))
    return materialize(
        union_all([build_run(r, mode, document) for mode, r in rankings.items()]))


def measure_modes(queries: DataFrame, lexical: Retriever, vector: Retriever, ranker: Ranker,
                  pool: int = 100, rrf_k: int = 60, slices: int = 4) -> DataFrame:
    """`(mode, slice, queries, seconds)`: seconds per query of each mode, for slices of the queries.

    Every stage is run to its end and timed on its own; a mode takes as long as the stages it is
    made of, so `reranked` includes retrieval, fusion and the ranker. For `latency_summary`.
    """
    spark = queries.sparkSession
    which = F.pmod(F.xxhash64("query_id"), F.lit(slices))
    counts = {r["i"]: r["n"] for r in
              queries.groupBy(which.alias("i")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    for i, n in sorted(counts.items()):
        some = queries.filter(which == i)

        def timed(stage: Callable[[], DataFrame]) -> tuple[DataFrame, float]:
            start = time.perf_counter()
            done = materialize(stage(), "timed")
            return done, (time.perf_counter() - start) / n
        bm25, a = timed(lambda: lexical(some))
        nearest, b = timed(lambda: vector(some))
        fused, c = timed(lambda: reciprocal_rank_fusion([bm25, nearest], rrf_k))
        _, d = timed(lambda: ranker(some, fused.filter(F.col("rank") <= pool)))
        seconds = (a, b, a + b + c, a + b + c + d)
        rows += [(mode, i, n, value) for mode, value in zip(MODES, seconds)]
    return spark.createDataFrame(rows, "mode string, slice int, queries bigint, seconds double")


def check_manifest(spark: SparkSession, path: str, config: dict) -> None:
    """Store the configuration of a job on its first start; refuse to go on with another one."""
    text = json.dumps(config, sort_keys=True)
    manifest = f"{path}/manifest"
    if path_exists(spark, f"{manifest}/_SUCCESS"):
        stored = spark.read.text(manifest).first()["value"]
        if stored != text:
            raise ValueError(f"stored configuration {stored} does not match {text}")
    else:
        spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(manifest)


def finished_queries(spark: SparkSession, path: str) -> DataFrame | None:
    """`(query_id, part)` of the queries whose results are complete, or None before the first."""
    if not path_exists(spark, f"{path}/finished"):
        return None
    return spark.read.parquet(f"{path}/finished")


def resume_run(queries: DataFrame, retrieve: Retriever, path: str, config: dict,
               slices: int = 8) -> DataFrame:
    """The results of all queries; only those without stored results are run, slice by slice.

    A slice first writes its results and then the ids of its queries. Results count only with such
    an id, so an interrupted slice is run again and its leftovers are not read. Queries may be added
    from call to call; each configuration needs its own `path`. Several slices bound what an
    interruption can cost.
    """
    if slices <= 0:
        raise ValueError("slices must be positive")
    spark = queries.sparkSession
    check_manifest(spark, path, config)
    done = finished_queries(spark, path)
    pending = materialize(queries if done is None else queries.join(done, "query_id", "left_anti"),
                          "pending")
    which = F.pmod(F.xxhash64("query_id"), F.lit(slices))
    for i in sorted(r["i"] for r in pending.select(which.alias("i")).distinct().collect()):
        some, part = pending.filter(which == i), uuid.uuid4().hex
        retrieve(some).write.parquet(f"{path}/runs/part={part}")
        some.select("query_id").write.parquet(f"{path}/finished/part={part}")
    if not path_exists(spark, f"{path}/runs"):
        return retrieve(queries.limit(0))
    asked = finished_queries(spark, path).join(queries.select("query_id"), "query_id", "left_semi")
    runs = spark.read.parquet(f"{path}/runs")
    return runs.join(asked, ["query_id", "part"], "left_semi").drop("part")


def _stages(queries: DataFrame, lexical: Retriever, vector: Retriever, ranker: Ranker, pool: int,
            rrf_k: int) -> dict[str, Callable[[dict[str, DataFrame]], DataFrame]]:
    """Each mode as a step over the results of the modes before it."""
    return dict(zip(MODES, (
        lambda done: lexical(queries),
        lambda done: vector(queries),
        lambda done: reciprocal_rank_fusion([done["bm25"], done["vector"]], rrf_k),
        lambda done: ranker(queries, done["rrf"].filter(F.col("rank") <= pool)))))


def _stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, float]:
    """A step's results and the seconds it took, from `path` if it was finished there before.

    The seconds are written last, so a step without them is run again and its leftovers replaced.
    """
    if not path_exists(spark, f"{path}/seconds/_SUCCESS"):
        start = time.perf_counter()
        make().write.mode("overwrite").parquet(f"{path}/results")
        spent = time.perf_counter() - start
        spark.createDataFrame([(spent,)], "seconds double").write.mode("overwrite").parquet(
            f"{path}/seconds")
    return (spark.read.parquet(f"{path}/results"),
            spark.read.parquet(f"{path}/seconds").first()["seconds"])


def resume_modes(queries: DataFrame, lexical: Retriever, vector: Retriever, ranker: Ranker,
                 path: str, config: dict, pool: int = 100, rrf_k: int = 60,
                 slices: int = 8) -> tuple[DataFrame, DataFrame]:
    """The four modes' run `(mode, query_id, doc_id, score, rank)` and what they took `(mode, part,
    queries, seconds)`, seconds per query, for all queries.

    Queries are run in slices. Within a slice each step is kept as soon as it is done, so after an
    interruption no step, and no model behind it, is asked again for what it has answered. The modes
    of a slice and their seconds count together, once the ids of its queries are written down; a
    slice is named by its queries, so the rerun finds its steps. A mode takes as long as the steps it
    is made of. Queries may be added from call to call; another configuration is refused.
    """
    if slices <= 0:
        raise ValueError("slices must be positive")
    spark = queries.sparkSession
    check_manifest(spark, path, {**config, "pool": pool, "rrf_k": rrf_k})
    done = finished_queries(spark, path)
    pending = materialize(queries if done is None else queries.join(done, "query_id", "left_anti"),
                          "pending")
    which = F.pmod(F.xxhash64("query_id"), F.lit(slices))
    found = pending.groupBy(which.alias("i")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("query_id", "text")).alias("mark"))
    for i, n, mark in sorted(tuple(r) for r in found.collect()):
        some = pending.filter(which == i)
        part = f"{i}-{n}-{mark & (1 << 64) - 1:016x}"
        ready: dict[str, DataFrame] = {}
        spent: dict[str, float] = {}
        for mode, make in _stages(some, lexical, vector, ranker, pool, rrf_k).items():
            ready[mode], spent[mode] = _stage(spark, f"{path}/steps/{part}/{mode}",
                                              lambda: make(ready))
        run = union_all([build_run(ready[mode], mode) for mode in MODES])
        run.write.mode("overwrite").parquet(f"{path}/runs/part={part}")
        fused = spent["bm25"] + spent["vector"] + spent["rrf"]
        seconds = (spent["bm25"], spent["vector"], fused, fused + spent["reranked"])
        spark.createDataFrame([(mode, n, s / n) for mode, s in zip(MODES, seconds)],
                              "mode string, queries bigint, seconds double").write.mode(
            "overwrite").parquet(f"{path}/times/part={part}")
        some.select("query_id").write.mode("overwrite").parquet(f"{path}/finished/part={part}")
    finished = finished_queries(spark, path)
    if finished is None:
        empty = {mode: lexical(queries.limit(0)) for mode in MODES}
        return (union_all([build_run(r, mode) for mode, r in empty.items()]),
                spark.createDataFrame([], "mode string, part string, queries bigint, seconds double"))
    asked = finished.join(queries.select("query_id"), "query_id", "left_semi")
    runs = spark.read.parquet(f"{path}/runs").join(asked, ["query_id", "part"], "left_semi")
    times = spark.read.parquet(f"{path}/times").join(asked.select("part").distinct(), "part",
                                                     "left_semi")
    return runs.drop("part"), times.select("mode", "part", "queries", "seconds")
