"""Filling in and replacing document embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.embed import EmbedFunction, EmbedPolicy, embed_documents
from ..session import streamable
from .evaluation import check_manifest


def backfill_embeddings(documents: DataFrame, embed: EmbedFunction, dims: int | None = None,
                        policy: EmbedPolicy = EmbedPolicy()) -> DataFrame:
    """All documents, those without an embedding embedded now.

    One pass: every row goes through one map step, and only pending ones reach the model. The frame
    is a plan; to keep what has been done, use `backfill_files`.
    """
    return embed_documents(documents, embed, dims=dims, policy=policy, missing_only=True)


def backfill_files(spark: SparkSession, source: str, target: str, embed: EmbedFunction, model: str,
                   dims: int, policy: EmbedPolicy = EmbedPolicy(), files_per_step: int = 1000,
                   text: str = "full_text", pattern: str = "*.parquet") -> DataFrame:
    """Fill in the missing embeddings of the Parquet files in a folder, in a new table at `target`.

    Every finished step is kept. After an interruption, or when files have been added to `source`,
    the same call goes on where it stopped; no text is sent to the model a second time.
    """
    if dims <= 0 or files_per_step <= 0:
        raise ValueError("dims and files_per_step must be positive")
    check_manifest(spark, target, {"model": model, "dims": dims})
    return _in_steps(spark, source, target, pattern, files_per_step, lambda files: embed_documents(
        files, embed, text=text, dims=dims, policy=policy, missing_only=True))


def _in_steps(spark: SparkSession, source: str, target: str, pattern: str, files_per_step: int,
              step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a map step over the files of a folder, or over one file, some files at a time, each noted
    when done."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(source).schema
    files = (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
             .option("maxFilesPerTrigger", files_per_step).parquet(streamable(spark, source)))
    (step(files).writeStream.format("parquet")
     .option("checkpointLocation", f"{target}/checkpoint")
     .option("path", f"{target}/documents")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{target}/documents")


def reembed_documents(spark: SparkSession, source: str, target: str, embed: EmbedFunction,
                      model: str, dims: int, confirm: bool = False,
                      policy: EmbedPolicy = EmbedPolicy(batch_size=20),
                      files_per_step: int = 1000, key: str = "doc_id",
                      text: str = "full_text", pattern: str = "*.parquet") -> DataFrame:
    """Embed every document of the Parquet files in a folder, or of one file, anew into a new table
    at `target`.

    The job reads the files of `source` in steps and notes each finished step in a checkpoint next
    to the result. After an interruption the same call goes on behind the last finished step; no
    document is sent to the model again, and none is written twice. Another model, width or corpus
    is refused, and so is a start without `confirm`.
    """
    if not confirm:
        raise ValueError("refusing to replace all embeddings without confirm=True")
    if dims <= 0 or files_per_step <= 0:
        raise ValueError("dims and files_per_step must be positive")
    corpus = spark.read.option("pathGlobFilter", pattern).parquet(source)
    state = corpus.agg(F.count(F.lit(1)).alias("n"),
                       F.coalesce(F.max(key).cast("string"), F.lit("")).alias("top")).first()
    check_manifest(spark, target, {"model": model, "dims": dims, "corpus_count": state["n"],
                                   "corpus_max_id": state["top"]})
    return _in_steps(spark, source, target, pattern, files_per_step, lambda files: embed_documents(
        files, embed, text=text, dims=dims, policy=policy))
