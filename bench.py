"""Time the headline queries and print one JSON line.

Reads the tables at $BENCH_SF_DIR with $BENCH_CPUS cores. Each query runs in full and its rows go to
Spark's noop sink. The index is built once, which is timed on its own; searches then read it.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame

from rankweave.plans import registry
from rankweave.session import build_session

HEADLINE = (
    "ingest_pages", "term_frequency", "doc_frequency", "bm25_topk", "bm25_batch", "bm25_rank_all",
    "bm25_sweep", "vector_topk", "vector_ann", "rrf", "hybrid_search", "rerank", "rerank_cosine",
    "legacy_rank", "embed_documents", "evaluate_run", "compare_modes", "stream_ingest",
)


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench",
                          spark__sql__shuffle__partitions=cpus,
                          spark__driver__memory="16g", spark__ui__enabled="false",
                          spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    consume(registry.table(spark, sf_dir, "documents"))  # start the engine

    seconds = {}
    start = time.perf_counter()
    registry.built_index(spark, sf_dir)
    seconds["build_index"] = time.perf_counter() - start
    queries = registry.all_queries()
    for name in HEADLINE:
        start = time.perf_counter()
        consume(queries[name](spark, sf_dir))
        seconds[name] = time.perf_counter() - start
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {name: round(value, 3) for name, value in seconds.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
