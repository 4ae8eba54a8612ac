"""Table schemas of the index and of the ranking and evaluation frames."""

from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("full_text", T.StringType(), False),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("len", T.IntegerType(), False),
])

TOKEN = T.StructType([
    T.StructField("token_id", T.LongType(), False),
    T.StructField("token", T.StringType(), False),
    T.StructField("doc_freq", T.LongType(), False),
])

TOKEN_POSITION = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("token_id", T.LongType(), False),
    T.StructField("position", T.IntegerType(), False),
])

# `len` of the document rides on every posting, so scoring needs no document join.
TERM_DOC_STATS = T.StructType([
    T.StructField("token_id", T.LongType(), False),
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("tf", T.LongType(), False),
    T.StructField("len", T.IntegerType(), False),
])

CORPUS_STATS = T.StructType([
    T.StructField("total_docs", T.LongType(), False),
    T.StructField("total_len", T.LongType()),
    T.StructField("avgdl", T.DoubleType()),
])

LINK = T.StructType([
    T.StructField("from_doc_id", T.LongType(), False),
    T.StructField("to_doc_id", T.LongType(), False),
])

PAGE = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])
