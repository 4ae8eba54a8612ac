"""Token ids in ORC files.

Documents are dealt out by ranges of their id, sorted, encoded and written: one row per document
with `doc_id`, `part` (the range), `place` (the row in it), `n_tokens` and `ids`. ORC keeps integers
run-length encoded and bit-packed, row indexes with least and largest value every so many rows, and
a Bloom filter on `doc_id`, so that a reader of one document opens one stripe and a reader of many
takes stripes in parallel.

Only texts are moved, once. Offsets are not kept in the rows, so no task waits for another: the
first id of a document is found from the `n_tokens` column of the files, summed within each part
and added to the sums of the parts before it (one number per part).

Defined cases: a null or empty text is one document with the end id alone. Null ids come first.
Rows of one id are ordered by a hash of the text and may lie in several parts; repeated rows are
written and counted each. An empty table gives files without rows. A very long text is encoded
window by window; what a task holds of it is the text and its ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import estimated_bytes, measured
from . import bpe
from .common import per_text, raw_texts, text_key

END_ID = 2
PART_BYTES = 16 * 1024 * 1024
MOST_PARTS = 20_000        # larger inputs get larger parts
UNKNOWN_BYTES = 1 << 60    # the planner's answer where it has no file sizes
STRIPE_BYTES = 16 * 1024 * 1024
ROW_INDEX_STRIDE = 1000


def _encoder(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def make():
        table = bpe.pieces(path)
        rows = 0

        def encode(texts: pa.StringArray) -> list:
            nonlocal rows
            place = np.arange(rows, rows + len(texts))
            rows += len(texts)
            ids = [one + end for one in table.encode(raw_texts(texts))[0]]
            sizes = np.array([len(x) // 4 for x in ids], np.int32)
            places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(places[-1]),
                                           [None, pa.py_buffer(b"".join(ids))])
            return [pa.array(place), pa.array(sizes), pa.ListArray.from_arrays(pa.array(places), values)]
        return encode
    return make


def write_token_files(docs: DataFrame, path: str, vocabulary: str, doc_id: str = "doc_id",
                      text: str = "text", end_id: int = END_ID,
                      part_bytes: int = PART_BYTES) -> None:
    """Encode every text and write ORC files in ascending id order to `path`."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
                       F.col(f"`{text}`").cast("string").alias("text"))
    size = estimated_bytes(docs)
    if size >= UNKNOWN_BYTES:  # not a scan of files
        size = measured(rows)[1]
    parts = min(max(spark.sparkContext.defaultParallelism, size // part_bytes), MOST_PARTS)
    # A hash of the text and the row's number split the rows of one id, or without one.
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_key"), F.col("row")]
    keyed = rows.withColumns({"text_key": text_key("text"),
                              "row": F.monotonically_increasing_id()})
    dealt = (keyed.repartitionByRange(int(parts), *order)
             .withColumn("part", F.spark_partition_id())
             .sortWithinPartitions(*order))
    (per_text(dealt, ["doc_id", "part"], "text", _encoder(vocabulary, end_id),
              "place bigint, n_tokens int, ids array<int>")
     .write.option("orc.bloom.filter.columns", "doc_id")
     .option("orc.stripe.size", STRIPE_BYTES)
     .option("orc.row.index.stride", ROW_INDEX_STRIDE)
     .option("orc.encoding.strategy", "COMPRESSION")
     .orc(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """`doc_id`, `part`, `place`, `n_tokens`, `ids`. Filters on `doc_id` skip stripes by their
    metadata."""
    return spark.read.schema(
        "doc_id bigint, part int, place bigint, n_tokens int, ids array<int>").orc(path)


def offsets(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The rows with `start`, the number of ids of all documents before each. If they are made from
    the files by some work, give the `files` too: sums are taken from them."""
    totals = (rows if files is None else files).groupBy("part").agg(
        F.sum(F.col("n_tokens").cast("bigint")).alias("n"))
    # One row per part, MOST_PARTS at most.
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n"))
                           .alias("before"))
    within = Window.partitionBy("part").orderBy("place").rowsBetween(
        Window.unboundedPreceding, -1)
    return (rows.join(F.broadcast(before), "part")
            .withColumn("start", F.col("before") + F.coalesce(
                F.sum(F.col("n_tokens").cast("bigint")).over(within), F.lit(0)))
            .drop("before"))


def _checksum(batches):
    """Unsigned CRC-32 over the little-endian bytes of each list of ids."""
    for batch in batches:
        names = batch.schema.names
        lists = batch.column(names.index("ids"))
        places = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        whole = memoryview(values.view(np.uint8))
        sums = [zlib.crc32(whole[4 * a:4 * b])
                for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
        columns = [batch.column(i) for i, n in enumerate(names) if n != "ids"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.int64())],
                                         names=[n for n in names if n != "ids"] + ["ids_crc32"])


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """`doc_id, start, n_tokens, ids_crc32` of every document, read from the files."""
    files = read_token_files(spark, path)
    small = files.mapInArrow(
        _checksum, "doc_id bigint, part int, place bigint, n_tokens int, ids_crc32 bigint")
    return offsets(small, files).select("doc_id", "start", F.col("n_tokens").cast("bigint")
                                 .alias("n_tokens"), "ids_crc32")
