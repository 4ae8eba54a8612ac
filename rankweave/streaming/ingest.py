"""Adding pages to an index as they arrive.

`stream_ingest` writes every batch as a partition of flat tables, to be compacted later.
`stream_segments` makes it a segment of a bucketed index, merged with others of its size on the way:
searches need no compaction, and pages that the index has are found by their ids, in the buckets and
row groups where these belong.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import Analyzer, words
from ..operators import lexical
from ..schemas import DOCUMENT, TERM_DOC_STATS, TOKEN_POSITION
from ..session import discard, materialize, path_exists, picked
from ..sources.corpus import extract_pages, first_pages
from ..sources import segments
from ..sources.index import (
    LexicalIndex, _positions, _postings, derive_index, last_commit, new_build, summed_stats,
    summed_tokens, write_forward, write_index,
)

BATCH_ID = T.StructField("batch_id", T.LongType())
SCHEMAS = {
    "forward": T.StructType([
        *DOCUMENT.fields, T.StructField("tokens", T.ArrayType(T.StringType())), BATCH_ID]),
    "term_doc_stats": T.StructType([*TERM_DOC_STATS.fields, BATCH_ID]),
    "token_position": T.StructType([*TOKEN_POSITION.fields, BATCH_ID]),
    "token": T.StructType([T.StructField("token", T.StringType()),
                           T.StructField("doc_freq", T.LongType()), BATCH_ID]),
    "corpus_stats": T.StructType([T.StructField("total_docs", T.LongType()),
                                  T.StructField("total_len", T.LongType()), BATCH_ID]),
}
FORWARD = SCHEMAS["forward"]
BLOOM = {"parquet.bloom.filter.enabled#doc_id": "true",
         "parquet.bloom.filter.enabled#url": "true"}


def _unseen(fresh: DataFrame, forward: DataFrame) -> DataFrame:
    """Documents of the batch that no other batch has written.

    The urls of the batch go to the Parquet reader, whose bloom filters skip the row groups of the
    index without any of them.
    """
    known = picked(forward.select("url"), "url", fresh).distinct()
    return fresh.join(known, "url", "left_anti").select(*fresh.columns)


def add_batch(pages: DataFrame, batch_id: int, path: str, key: str = "page_id",
              analyzer: Analyzer = words) -> None:
    """Index one batch of pages; running the same batch again leaves the same index.

    Everything the batch writes goes into partition `batch_id`, which a replay replaces. Urls are
    compared with the other batches only, so a replay does not find itself.
    """
    spark = pages.sparkSession
    readable = pages.filter(F.col("html").isNotNull())
    fresh = materialize(extract_pages(first_pages(readable, key), key).drop("arrival"), "batch")
    if path_exists(spark, f"{path}/forward"):
        others = (spark.read.schema(FORWARD).parquet(f"{path}/forward")
                  .filter(F.col("batch_id") != batch_id))
        fresh = _unseen(fresh, others)

    def write(df: DataFrame, name: str) -> None:
        (df.withColumn("batch_id", F.lit(batch_id).cast("long")).write
         .mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .options(**(BLOOM if name == "forward" else {}))
         .partitionBy("batch_id").parquet(f"{path}/{name}"))

    write(lexical.analyze(fresh, analyzer), "forward")
    forward = (spark.read.schema(FORWARD).parquet(f"{path}/forward")
               .filter(F.col("batch_id") == batch_id).drop("batch_id"))
    write(_postings(lexical.term_frequency(forward)), "term_doc_stats")
    write(_positions(forward, None), "token_position")
    write(lexical.doc_frequency(forward.select(F.explode(F.array_distinct("tokens"))
                                               .alias("token"))), "token")
    write(forward.agg(F.count(F.lit(1)).alias("total_docs"),
                      F.sum(F.col("len").cast("long")).alias("total_len")), "corpus_stats")


def stream_ingest(pages: DataFrame, path: str, checkpoint: str, key: str = "page_id",
                  analyzer: Analyzer = words, trigger: dict | None = None):
    """Start a streaming query that adds the pages of a stream to the index at `path`."""
    return (pages.writeStream
            .foreachBatch(lambda batch, batch_id: add_batch(batch, batch_id, path, key, analyzer))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start())


def add_segment(pages: DataFrame, batch_id: int, path: str, key: str = "page_id",
                analyzer: Analyzer = words, buckets: int | None = None,
                fanout: int = segments.FANOUT) -> None:
    """Make a batch of pages a segment of the index at `path`, the first one the index itself.

    The manifest row that makes a segment live tells its batch too, so a batch that runs again, the
    last one only in a stream, is either live as a whole and left out, or not at all and written
    anew. Ids of pages follow from their urls.
    """
    spark = pages.sparkSession
    started = path_exists(spark, f"{path}/manifest")
    done = last_commit(spark, path)["batch"] if started else None
    if done is not None and batch_id <= done:
        return
    readable = pages.filter(F.col("html").isNotNull())
    fresh = materialize(extract_pages(first_pages(readable, key), key).drop("arrival"), "batch")
    if started:
        segments.add_documents(fresh, path, analyzer, fanout=fanout, urls=False, batch=batch_id)
    elif not fresh.isEmpty():
        write_index(fresh, path, analyzer, buckets=buckets, batch=batch_id)
    discard(fresh)


def stream_segments(pages: DataFrame, path: str, checkpoint: str, key: str = "page_id",
                    analyzer: Analyzer = words, buckets: int | None = None,
                    fanout: int = segments.FANOUT, trigger: dict | None = None):
    """Start a streaming query that adds the pages of a stream to a bucketed index; read it with
    `open_index`. Give `buckets` for what the index is to become."""
    return (pages.writeStream
            .foreachBatch(lambda batch, batch_id: add_segment(batch, batch_id, path, key, analyzer,
                                                              buckets, fanout))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start())


def read_stream_index(spark: SparkSession, path: str, analyzer: Analyzer = words) -> LexicalIndex:
    """The index over all batches; counts of the batches are added up."""
    def table(name: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}").drop("batch_id")

    tokens = table("token").select(lexical.token_id(F.col("token")).alias("token_id"), "token",
                                   "doc_freq")
    return LexicalIndex(
        document=table("forward").drop("tokens"),
        token=summed_tokens(tokens),
        term_doc_stats=table("term_doc_stats"),
        token_position=table("token_position"),
        corpus_stats=summed_stats(table("corpus_stats")),
        analyzer=analyzer,
    )


def compact(spark: SparkSession, path: str, target: str, **options) -> LexicalIndex:
    """Rewrite a streamed index as a bucketed one at `target`; the text is not analyzed again."""
    build = new_build(target)
    rows = spark.read.schema(SCHEMAS["forward"]).parquet(f"{path}/forward").drop("batch_id")
    buckets = write_forward(rows, build, None, options.pop("buckets", None))
    return derive_index(spark, target, build, buckets, **options)
