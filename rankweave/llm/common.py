"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Texts are worked on in slices of about this many bytes, which bounds the memory of a task.
SLICE_BYTES = 2 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str) -> Column:
    """Tells rows of one id with different texts apart."""
    column = F.col(f"`{text}`")
    return F.when(column.isNull(), F.lit(0)).otherwise(F.xxhash64(column))


def as_texts(array: pa.Array) -> pa.StringArray:
    """A plain string array without nulls (null becomes empty)."""
    array = array.cast(pa.string()) if array.type != pa.string() else array
    return array.fill_null("") if array.null_count else array


def slices(array: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `limit` bytes of text each, one row at least."""
    ends = text_bytes(array)[1]
    start, n = 0, len(array)
    while start < n:
        stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


def text_bytes(array: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts behind one another and the offsets of the texts in them.

    Both are views of Arrow's memory, so nothing is copied.
    """
    _, offsets, data = array.buffers()
    if offsets is None or len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    places = np.frombuffer(offsets, np.int32)[array.offset:array.offset + len(array) + 1]
    first, last = int(places[0]), int(places[-1])
    raw = np.frombuffer(data, np.uint8)[first:last] if data is not None else np.zeros(0, np.uint8)
    return raw, places.astype(np.int64) - first


def raw_texts(array: pa.StringArray) -> list[bytes]:
    """Each text as bytes."""
    raw, places = text_bytes(array)
    whole = raw.tobytes()
    return [whole[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist())]


def per_text(docs: DataFrame, keep: list[str], text: str,
             make: Callable[[], Callable[[pa.StringArray], list]], fields: str) -> DataFrame:
    """The `keep` columns of `docs` and `fields` worked out from each whole text, in one map step.

    `make` is called once in a task and returns the function that turns an array of texts into one
    array (or list) per field. Nothing is shuffled.
    """
    added = T._parse_datatype_string(fields)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep],
                       F.col(f"`{text}`").cast("string").alias("_text"))
    schema = T.StructType([*rows.schema.fields[:len(keep)], *added.fields])
    types = [arrow_type(f.dataType) for f in added.fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for batch in batches:
            fn = fn or make()
            texts = as_texts(batch.column(len(keep)))
            for start, stop in slices(texts):
                found = fn(texts.slice(start, stop - start))
                columns = [batch.column(i).slice(start, stop - start) for i in range(len(keep))]
                columns += [a if isinstance(a, pa.Array) else pa.array(a, t)
                            for a, t in zip(found, types)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    """Arrow's type for the column types used here."""
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
            "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[
                kind.simpleString()]
