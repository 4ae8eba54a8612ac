"""Bounded samples of labelled texts for the learned operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % n


def labelled_sample(rows: DataFrame, bound: int, labels: DataFrame | None = None,
                    by_label: bool = False) -> DataFrame:
    """`text, label`: about `bound` distinct texts of `rows`, chosen by hash.

    `rows` has doc_id and text, and the label unless `labels` (doc_id, label; one row per document)
    has it. With `by_label`, about `bound` texts for each label are chosen. Equal texts count once,
    so a group of copies cannot fill the sample; their most frequent label is taken. The share is
    worked out from a count over all rows, and a text is in or out by its hash alone, so the sample
    is the same in every run, has the labels' own proportions, and its size does not grow with the
    table. Only hashes, ids and labels are shuffled; the texts of the chosen rows are then picked by
    a broadcast of their ids, as many as are chosen.
    """
    spark = rows.sparkSession
    narrow = rows.select("doc_id", F.xxhash64("text").alias("h"),
                         *([] if labels is not None else ["label"]))
    if labels is not None:
        narrow = narrow.join(labels, "doc_id")
    distinct = materialize(
        narrow.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("h").agg(F.mode("label", True).alias("label"), F.min("doc_id").alias("doc_id")),
        "learnable")
    group = F.col("label") if by_label else F.lit(0)
    counts = {r["g"]: r["n"] for r in
              distinct.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return distinct.select(F.lit("").alias("text"), "label").limit(0)
    grain = 1 << 40  # the low 40 bits of the hash decide
    shares = [(g, min(grain, int(grain * bound / n))) for g, n in counts.items()]
    low = F.col("h").bitwiseAND(F.lit(grain - 1))
    if by_label:
        limits = spark.createDataFrame(
            shares, f"label {distinct.schema['label'].dataType.simpleString()}, share bigint")
        chosen = distinct.join(F.broadcast(limits), "label").filter(low < F.col("share"))
    else:
        chosen = distinct.filter(low < F.lit(shares[0][1]))
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "label")
    picked = rows.select("doc_id", "text", F.xxhash64("text").alias("h")).join(
        F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("h") == F.col("_h")))
    # A repeated row is taken once.
    return picked.groupBy("_id", "_h").agg(F.first("text").alias("text"),
                                           F.first("label").alias("label")).select("text", "label")
