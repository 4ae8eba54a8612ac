"""Reading corpora, pages, queries and relevance judgments into the common schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.html import html_links, html_text, html_title
from ..functions.text import document_body, query_text
from ..operators.topk import top_k
from ..session import lookup_join, materialize


def read_table(spark: SparkSession, path: str, file_format: str = "parquet", schema=None,
               **options) -> DataFrame:
    """Any file format Spark reads, by name; give a schema for JSON and CSV."""
    reader = spark.read.format(file_format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def url_doc_id(url: Column, source_key: Column, wide: bool = False) -> Column:
    """Document id from the url, or from the caller's own key where there is no url.

    The same input always gets the same id, in batch and in a stream. The 64-bit form suits up to
    about a billion documents; above that use the 128-bit form, a hex string.
    """
    name = F.coalesce(F.concat(F.lit("url:"), url), F.concat(F.lit("key:"), source_key.cast("string")))
    return F.md5(name) if wide else F.xxhash64(name)


def ingest_corpus(rows: DataFrame, doc_id: str = "doc_id", title: str | None = "title",
                  text: str = "text", body: str | None = None,
                  limit: int | None = None) -> DataFrame:
    """A corpus as `(url, title, full_text)`; the outer document id becomes the url."""
    title_col = F.col(title) if title else F.lit(None).cast("string")
    out = rows.select(
        F.col(doc_id).cast("string").alias("url"),
        F.nullif(title_col, F.lit("")).alias("title"),
        document_body(title_col, F.col(text), F.col(body) if body else None).alias("full_text"),
    )
    return out if limit is None else out.limit(limit)


def dedupe_url(rows: DataFrame, arrival: str, existing: DataFrame | None = None) -> DataFrame:
    """First write wins per url; rows without a url are all kept.

    A url that makes up a large part of the rows is cut to one row inside every map task before
    the shuffle. Rows without a url take no part in the shuffle. Among rows of one url that arrived
    at the same time a hash of the row decides, so the choice is the same in every run.
    """
    named = rows.filter(F.col("url").isNotNull())
    order = [F.col(arrival).asc(), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).asc()]
    first = top_k(named, ["url"], order, 1, rank_col="_n").drop("_n")
    if existing is not None:
        known = existing.select("url").filter(F.col("url").isNotNull())
        first = first.join(known, "url", "left_anti").select(*rows.columns)
    return first.unionByName(rows.filter(F.col("url").isNull()))


def extract_pages(pages: DataFrame, key: str = "page_id", compat: bool = False,
                  wide_ids: bool = False) -> DataFrame:
    """Raw `(key, url, html)` pages to documents, one row each, nothing filtered."""
    return pages.select(
        url_doc_id(F.col("url"), F.col(key), wide_ids).alias("doc_id"),
        html_text(F.col("html"), compat=compat).alias("full_text"),
        "url",
        html_title(F.col("html")).alias("title"),
        F.col(key).alias("arrival"),
    )


def ingest_pages(pages: DataFrame, key: str = "page_id", existing: DataFrame | None = None,
                 compat: bool = False, wide_ids: bool = False) -> DataFrame:
    """Documents of a page table; unreadable pages are left to `rejected_pages`.

    Of the pages of one url the first is taken, as `dedupe_url` does, before any text is extracted.
    """
    first = first_pages(pages.filter(F.col("html").isNotNull()), key)
    documents = extract_pages(first, key, compat, wide_ids).drop("arrival")
    if existing is None:
        return documents
    known = existing.select("url").filter(F.col("url").isNotNull())
    return documents.join(known, "url", "left_anti").select(*documents.columns)


def first_pages(pages: DataFrame, key: str) -> DataFrame:
    """The first page of every url by `key` (by a hash of the page among equal keys), and all pages
    without a url.

    Only urls, keys and hashes are shuffled. Urls with several pages are written down and joined
    back to the pages as a lookup table; repeated rows of a first page are cut to one.
    """
    rows = pages.select(key, "url", "html").withColumn("_h", F.xxhash64("html"))
    kinds = (rows.filter(F.col("url").isNotNull()).groupBy("url", key, "_h")
             .agg(F.count(F.lit(1)).alias("_n")))
    several = materialize(
        kinds.groupBy("url").agg(F.min(F.struct(key, "_h", "_n")).alias("_first"),
                                 F.sum("_n").alias("_all"))
        .filter("_all > 1").drop("_all"), "several")
    marked = lookup_join(rows, several, "url", "left")
    own = F.col("_first")
    kept = marked.filter(own.isNull() | (own[key].eqNullSafe(F.col(key)) & (own["_h"] == F.col("_h"))))
    columns = [key, "url", "html"]
    if several.filter(own["_n"] > 1).isEmpty():
        return kept.select(*columns)
    again = F.coalesce(own["_n"] > 1, F.lit(False))
    return kept.filter(~again).select(*columns).unionByName(
        kept.filter(again).dropDuplicates(["url"]).select(*columns))


def rejected_pages(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages that could not be fetched, with the reason."""
    return (pages.filter(F.col("html").isNull())
            .select(F.col(key), "url", F.lit("no content").alias("reason")))


def page_links(pages: DataFrame) -> DataFrame:
    """`(url, links)` for `link_edges`."""
    return pages.select("url", html_links(F.col("html")).alias("links"))


def load_queries(rows: DataFrame, query_id: str = "query_id", text: str = "text",
                 title: str | None = None) -> DataFrame:
    """`(query_id, text)`; the title stands in for an empty text, empty queries are dropped."""
    return (rows.select(F.col(query_id).alias("query_id"),
                        query_text(F.col(text), F.col(title) if title else None).alias("text"))
            .filter(F.col("text").isNotNull()))


def load_qrels(rows: DataFrame, seq: str | None = None) -> DataFrame:
    """Positive judgments, one per (query, document); the last in `seq` order wins.

    Non-positive rows are dropped first, so a later 0 does not take back a positive judgment.
    """
    positive = rows.filter(F.col("relevance") > 0)
    last = F.max_by("relevance", seq) if seq else F.max("relevance")
    return (positive.groupBy("query_id", "doc_id")
            .agg(last.cast("int").alias("relevance")))
