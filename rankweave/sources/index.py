"""The index on disk: built once, opened by any session, searched many times.

Layout; each build has a folder of its own, all Parquet:

    manifest/                 one JSON row per commit: its build, buckets, analyzer, lexicon
    build-<id>/
      forward/          doc_id, full_text, url, title, len, tokens     (bucketed by doc_id)
      token/            token_id, token, doc_freq                      (range-sorted by token)
      term_doc_stats/   token_id, doc_id, tf, len                      (bucketed by doc_id)
      token_position/   doc_id, token_id, position                     (bucketed by doc_id)
      term_blocks/      token_id, block, n, max_tf, min_len            (range-sorted by token_id)
      corpus_stats/     one row

A build joins the manifest when all its tables are complete, and readers open the last one there.
An interrupted build is never seen, and sessions that have an earlier one open keep it. A build may
be one of several segments that make up the index together (see `segments`): the manifest row names
the live ones, and of a merge under way the tables that it has done. All have the same buckets, and a
bucket of the index is that bucket of every segment.

Text is dealt to buckets by document, which is the one shuffle of a build, and tokenized in the pass
that writes `forward`, sorted by document in small row groups: the store in which texts are looked up
by id. Every other table is derived from its token column, bucket by bucket and without a shuffle of
postings. Postings and positions are sorted by token inside a bucket, so a search adds up the scores
of a document where its postings lie: nothing but the final top k per query is shuffled. A frequent
token is spread over all buckets.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import Analyzer, words
from ..operators import lexical
from ..session import (
    BROADCAST_BYTES, GROUP_BYTES, discard, freed_shuffles, lookup_join, materialize, path_exists,
    settings,
)

# Bucket size: a task holds the scores of a bucket's documents for all queries, so buckets stay small
# as the corpus grows. From so many buckets on they grow instead: still smaller ones would make the
# one shuffle of the build too fine-grained.
TEXT_PER_BUCKET = 48_000_000
MOST_BUCKETS = 4096


# Blocks of documents refine the buckets. A token has a row for all blocks, and if it has enough
# postings one for each block it is in.
ALL_BLOCKS = -1
BLOCKS_PER_BUCKET = 64
MOST_BLOCKS = 65_536
POSTINGS_PER_BLOCK = 4


def blocks_of(buckets: int) -> int:
    return buckets * max(1, min(BLOCKS_PER_BUCKET, MOST_BLOCKS // buckets))


def block_of(doc_id: Column, blocks: int) -> Column:
    """Documents of a block lie in one bucket, since buckets are numbered by the same hash."""
    return F.pmod(F.hash(doc_id), F.lit(blocks))


@dataclass(frozen=True)
class LexicalIndex:
    document: DataFrame
    token: DataFrame
    term_doc_stats: DataFrame
    token_position: DataFrame
    corpus_stats: DataFrame
    analyzer: Analyzer = words
    lexicon: DataFrame | None = None
    # Number of buckets the postings lie in.
    buckets: int = 1
    # Names under which the session's catalog knows the bucketed files.
    tables: tuple[str, ...] = ()
    # What bounds the scores of a token, and the number of blocks; only of a written index.
    term_blocks: DataFrame | None = None
    blocks: int = 1


def build_index(documents: DataFrame, analyzer: Analyzer = words,
                lexicon: DataFrame | None = None) -> LexicalIndex:
    """The index tables as plans over `documents`, for small corpora and one-off searches."""
    analyzed = lexical.analyze(documents, analyzer)
    postings = lexical.term_frequency(analyzed, lexicon)
    return _tables(analyzed, postings, analyzer, lexicon)


def _positions(analyzed: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    rows = lexical.lemmatize(lexical.token_positions(analyzed), lexicon)
    return rows.select("doc_id", lexical.token_id(F.col("token")).alias("token_id"), "position")


def _tokens(postings: DataFrame) -> DataFrame:
    return lexical.doc_frequency(postings).select(
        lexical.token_id(F.col("token")).alias("token_id"), "token", "doc_freq")


def _postings(postings: DataFrame) -> DataFrame:
    return postings.select(lexical.token_id(F.col("token")).alias("token_id"),
                           "doc_id", "tf", "len")


# Tokens that are counted together, or those of one document.
BLOCK_TOKENS = 500_000


def _parts(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """A batch of documents in runs of about `size` tokens."""
    length = pc.fill_null(pc.list_value_length(batch.column("tokens")), 0)
    block = np.cumsum(length.to_numpy(zero_copy_only=False), dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        yield batch.slice(start, end - start)


def _terms(tokens: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """`values, document, code, n` of lists of tokens, one list for a document: the distinct tokens
    of all, and per document and token in it the number of the token and how often it occurs."""
    length = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    document = np.repeat(np.arange(len(tokens)), length)
    encoded = tokens.flatten().dictionary_encode(null_encoding="encode")
    size = max(len(encoded.dictionary), 1)
    pairs, n = np.unique(document * size + encoded.indices.to_numpy(zero_copy_only=False),
                         return_counts=True)
    return encoded.dictionary, pairs // size, pairs % size, n


def _counted(forward: DataFrame) -> DataFrame:
    """Postings of a `forward`, counted where its rows lie, without a shuffle.

    Documents are counted some at a time and go out as rows with a list, so a task holds the tokens
    of these and not a table of all postings of its bucket.
    """
    size = BLOCK_TOKENS
    term = T.StructType([T.StructField("token", T.StringType()), T.StructField("tf", T.LongType())])
    schema = T.StructType([forward.schema["doc_id"], forward.schema["len"],
                           T.StructField("terms", T.ArrayType(term))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole, size)):
            values, document, code, n = _terms(batch.column("tokens"))
            ends = np.searchsorted(document, np.arange(batch.num_rows + 1)).astype(np.int32)
            terms = pa.StructArray.from_arrays(
                [values.take(pa.array(code)), pa.array(n.astype(np.int64))], names=["token", "tf"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("len"),
                 pa.ListArray.from_arrays(pa.array(ends), terms)], names=["doc_id", "len", "terms"])

    counted = forward.select("doc_id", "len", "tokens").mapInArrow(run, schema)
    return _postings(counted.select("doc_id", "len", F.inline("terms"))
                     .filter(F.col("token").isNotNull()))


def _counted_tokens(forward: DataFrame) -> DataFrame:
    """The tokens of a `forward`: its documents are counted some at a time, and their counts, a row
    for each token of these, are added up."""
    schema = T.StructType([T.StructField("token", T.StringType()),
                           T.StructField("n", T.LongType())])
    size = BLOCK_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole, size)):
            values, _, code, _ = _terms(batch.column("tokens"))
            n = np.bincount(code, minlength=len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([values, pa.array(n)], names=["token", "n"])

    # A scan keeps to buckets only where their key is read.
    counted = forward.select("doc_id", "tokens").mapInArrow(run, schema)
    return counted.groupBy("token").agg(F.sum("n").alias("doc_freq")).select(
        lexical.token_id(F.col("token")).alias("token_id"), "token", "doc_freq")


def _tables(analyzed: DataFrame, postings: DataFrame, analyzer: Analyzer,
            lexicon: DataFrame | None) -> LexicalIndex:
    return LexicalIndex(
        document=analyzed.drop("tokens"),
        token=_tokens(postings),
        term_doc_stats=_postings(postings),
        token_position=_positions(analyzed, lexicon),
        corpus_stats=lexical.corpus_stats(analyzed),
        analyzer=analyzer,
        lexicon=lexicon,
    )


# Bloom filters and small row groups: a lookup of some documents decodes little else.
# A filter is as large as its row group needs, not a megabyte each.
# All tables are written once and for long.
COMPRESSION = {"compression": "zstd"}
FORWARD_OPTIONS = {"parquet.bloom.filter.enabled#doc_id": "true",
                   "parquet.bloom.filter.adaptive.enabled": "true",
                   "parquet.bloom.filter.enabled#url": "true",
                   "parquet.block.size": str(GROUP_BYTES)}


def new_build(path: str) -> str:
    """The folder of a new build of the index at `path`."""
    return f"{path}/build-{uuid.uuid4().hex[:12]}"


def write_index(documents: DataFrame, path: str, analyzer: Analyzer = words,
                lexicon: DataFrame | None = None, buckets: int | None = None,
                positions: bool = True, batch: int | None = None) -> LexicalIndex:
    """Build and write the index, which takes the place of the one at `path`, and open it.

    `documents` holds `doc_id, full_text, url, title`. `batch` is the number of the batch of a
    stream that they are.
    """
    build = new_build(path)
    buckets = write_forward(documents, build, analyzer, buckets)
    return derive_index(documents.sparkSession, path, build, buckets, analyzer, lexicon, positions,
                        batch=batch)


def buckets_for(documents: DataFrame) -> int:
    """The number of buckets of an index of these documents, or that they are going to make up."""
    size = documents.agg(F.sum(F.octet_length("full_text").cast("long"))).first()[0] or 0
    return max(documents.sparkSession.sparkContext.defaultParallelism,
               min(-(-size // TEXT_PER_BUCKET), MOST_BUCKETS))


def write_forward(documents: DataFrame, build: str, analyzer: Analyzer | None = words,
                  buckets: int | None = None) -> int:
    """Write `forward` of a build; the number of its buckets. Without an analyzer the documents have
    their tokens already."""
    if buckets is None:
        buckets = buckets_for(documents)
    dealt = documents.repartition(buckets, "doc_id")
    rows = dealt if analyzer is None else lexical.analyze(dealt, analyzer)
    _save_buckets(rows, f"{build}/forward", buckets, "doc_id", FORWARD_OPTIONS)
    return buckets


def derive_index(spark: SparkSession, path: str, build: str, buckets: int,
                 analyzer: Analyzer = words, lexicon: DataFrame | None = None,
                 positions: bool = True, others: list[str] | None = None,
                 batch: int | None = None) -> LexicalIndex:
    """Write all other tables of a build from the tokens in its `forward`, and open the index.

    A task reads documents of one bucket, or a few, and writes postings of the same ones. `others`
    are the segments that stay beside this one.
    """
    forward = spark.read.parquet(f"{build}/forward")
    lexical.corpus_stats(forward).write.parquet(f"{build}/corpus_stats")

    if lexicon is None:
        table, placed = open_buckets(spark, [f"{build}/forward"], buckets, BUCKETED["forward"])
        with bucket_tasks(spark):
            _save_buckets(_counted(placed), f"{build}/term_doc_stats", buckets)
            if positions:
                _save_buckets(_positions(placed, None), f"{build}/token_position", buckets)
            _save_tokens(_counted_tokens(placed), f"{build}/token")
        spark.sql(f"DROP TABLE {table}")
    else:
        by_doc = lexical.lemmatize(lexical.term_frequency(forward), lexicon).repartition(
            buckets, "doc_id")
        postings = by_doc.groupBy("doc_id", "token").agg(
            F.sum("tf").alias("tf"), F.first("len").alias("len"))
        _save_buckets(_postings(postings), f"{build}/term_doc_stats", buckets)
        if positions:
            _save_buckets(_positions(forward, lexicon), f"{build}/token_position", buckets)
        distinct = forward.select(F.explode(F.array_distinct("tokens")).alias("token"), "doc_id")
        # Two forms of one lemma in a document count once.
        distinct = lexical.lemmatize(distinct, lexicon).distinct()
        _save_tokens(_tokens(distinct), f"{build}/token")

    others = others or []
    write_blocks(spark, path, build, buckets, others)
    commit(spark, path, [*others, build.rsplit("/", 1)[-1]], buckets, positions,
           analyzer_name(analyzer), lexicon_mark(lexicon), batch)
    return open_index(spark, path, analyzer, lexicon)


def commit(spark: SparkSession, path: str, live: list[str], buckets: int, positions: bool,
           analyzer: str, lexicon: str, batch: int | None = None,
           merging: tuple[str, list[str], dict[str, int]] | None = None) -> None:
    """Make the given segments the index; the last one is the newest. `batch` is the last batch of a
    stream that they hold. `merging` is the build that takes the place of some of them, their names
    and how many buckets of a table it has already."""
    row = (live[-1], time.time(), buckets, positions, analyzer, lexicon, live, batch, merging)
    (spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append")
     .json(f"{path}/manifest"))


def last_commit(spark: SparkSession, path: str) -> dict:
    """The manifest row that holds now."""
    row = spark.read.schema(MANIFEST).json(f"{path}/manifest").orderBy(
        F.col("written").desc()).first().asDict(recursive=True)
    return {**row, "segments": row["segments"] or [row["build"]]}


def open_table(spark: SparkSession, path: str, last: dict, kind: str) -> tuple[str, DataFrame]:
    """Open a bucketed table of all live segments.

    Of a merge under way the first buckets lie in the new build, the others in the segments merged,
    whatever is left in their files of buckets that do not count.
    """
    builds, buckets, order = last["segments"], last["buckets"], BUCKETED[kind]
    merging = last["merging"] or {"build": None, "names": [], "done": {}}
    done = merging["done"].get(kind, 0)
    if done:
        old = [name for name in builds if name in merging["names"]]
        builds = [name for name in builds if done < buckets or name not in old] + [merging["build"]]
    paths = [f"{path}/{build}/{kind}" for build in builds]
    if done in (0, buckets):
        return open_buckets(spark, paths, buckets, order)
    # Files change with every step of the merge, so the table has a name for each.
    table, rows = open_buckets(spark, paths, buckets, order, str(done), drop=False)
    bucket = F.pmod(F.hash("doc_id"), F.lit(buckets))
    segment = F.col("segment")
    counts = (F.when(segment == len(builds) - 1, bucket < done)
              .when(segment.isin([builds.index(name) for name in old]), bucket >= done)
              .otherwise(True))
    return table, rows.filter(counts).drop("segment")


def write_blocks(spark: SparkSession, path: str, build: str, buckets: int,
                 others: list[str]) -> None:
    beside = (spark.read.parquet(*[f"{path}/{name}/term_blocks" for name in others])
              if others else None)
    rows, steps = _term_blocks(spark.read.parquet(f"{build}/term_doc_stats"), blocks_of(buckets),
                               beside)
    with freed_shuffles(spark):
        (rows.repartitionByRange("token_id").sortWithinPartitions("token_id", "block")
         .write.mode("overwrite").options(**COMPRESSION).parquet(f"{build}/term_blocks"))
    for step in steps:
        discard(step)


def _term_blocks(postings: DataFrame, blocks: int, beside: DataFrame | None = None
                 ) -> tuple[DataFrame, list[DataFrame]]:
    """`token_id`, `block`, `n`, `max_tf`, `min_len`: what the scores of a token are bounded by;
    and the frames written on the way.

    Postings are reduced in the map tasks, each of which has documents of few blocks; only those of
    frequent tokens are counted by block. A token has rows by block in all segments it is in or in
    none, so that the rows of segments add up: what it has in the other segments, `beside`, decides,
    and its frequency only where it is in none.
    """
    bounds = (F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"),
              F.min("len").alias("min_len"))
    with freed_shuffles(postings.sparkSession):
        whole = materialize(postings.groupBy("token_id").agg(*bounds), "blocks")
    fine = whole.filter(F.col("n") >= POSTINGS_PER_BLOCK * blocks).select("token_id")
    if beside is not None:
        is_whole = F.col("block") == ALL_BLOCKS
        fine = fine.join(beside.filter(is_whole), "token_id", "left_anti").unionByName(
            whole.select("token_id").join(beside.filter(~is_whole), "token_id", "left_semi"))
    with freed_shuffles(postings.sparkSession):
        fine = materialize(fine, "fine")
    by_block = (lookup_join(postings, fine, "token_id", "left_semi")
                .groupBy("token_id", block_of(F.col("doc_id"), blocks).alias("block")).agg(*bounds))
    return whole.withColumn("block", F.lit(ALL_BLOCKS)).unionByName(by_block), [whole, fine]


MANIFEST = ("build string, written double, buckets int, positions boolean, analyzer string, "
            "lexicon string, segments array<string>, batch long, "
            "merging struct<build: string, names: array<string>, done: map<string, int>>")


def analyzer_name(analyzer: Analyzer) -> str:
    return (f"{getattr(analyzer, '__module__', '')}."
            f"{getattr(analyzer, '__qualname__', type(analyzer).__name__)}")


def lexicon_mark(lexicon: DataFrame | None) -> str:
    """Tells lexicons with different rows apart."""
    if lexicon is None:
        return "none"
    row = lexicon.select("form", "lemma").distinct().agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("form", "lemma")).alias("x")).first()
    return f"{row['n']}:{row['x']}"


# A writer keeps the files of so many buckets open; for more it sorts by bucket.
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
MOST_OPEN_FILES = 16


def _save_buckets(rows: DataFrame, path: str, buckets: int, order: str = "token_id",
                  options: dict[str, str] | None = None, append: bool = False) -> None:
    """Write rows into the files of their buckets, whatever task has them. With `append` they come
    beside other buckets that the table has.

    Where a task has the rows of one bucket, or a few, it sorts them once by the one key and keeps
    the files of its buckets open. A sort by bucket and key, as the writer would do, compares whole
    rows.
    """
    spark, table = rows.sparkSession, _table_name()
    ordered = rows.sortWithinPartitions(order)
    options = {**COMPRESSION, **(options or {})}
    if append:
        # Rows that are appended are written with the options of the table.
        columns = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
        given = ", ".join(f"'{name}' = '{value}'" for name, value in options.items())
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet OPTIONS ({given}) "
                  f"CLUSTERED BY (doc_id) INTO {buckets} BUCKETS LOCATION '{path}'")
    with settings(spark, {OPEN_FILES: str(MOST_OPEN_FILES)}), freed_shuffles(spark):
        (ordered.write.mode("append" if append else "overwrite").options(**options)
         .bucketBy(buckets, "doc_id").option("path", path).saveAsTable(table))
    # Only the name goes; the files of a table with its own path stay.
    spark.sql(f"DROP TABLE {table}")


def _save_tokens(tokens: DataFrame, path: str) -> None:
    with freed_shuffles(tokens.sparkSession):
        (tokens.repartitionByRange("token").sortWithinPartitions("token")
         .write.mode("overwrite").options(**COMPRESSION).parquet(path))


# A batch handed to Python holds the tokens of so many documents at most.
BATCH_DOCUMENTS = 1000


def bucket_tasks(spark: SparkSession) -> AbstractContextManager[None]:
    """Bucketed tables are read with a task for each bucket, though no step of a plan asks for it,
    and handed to Python in small batches."""
    return settings(spark, {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
                            "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_DOCUMENTS)})


def table_of(paths: list[str], state: str = "") -> str:
    return f"rankweave_{hashlib.md5(' '.join(paths).encode() + state.encode()).hexdigest()[:16]}"


def open_buckets(spark: SparkSession, paths: list[str], buckets: int,
                 order: str = "token_id", state: str = "",
                 drop: bool = True) -> tuple[str, DataFrame]:
    """Name the files as a bucketed table, so that the planner knows how rows are placed.

    The files of several segments are partitions of one table: a task has a bucket of all of them.
    The name follows from the paths, and the state of their files if that changes, so opening again
    finds the same table. Without `drop` rows keep the number of their segment.
    """
    table = table_of(paths, state)
    columns = ", ".join(f"{name} {kind}" for name, kind in spark.read.parquet(*paths).dtypes)
    placed = f"CLUSTERED BY (doc_id) SORTED BY ({order}) INTO {buckets} BUCKETS"
    if len(paths) == 1:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet {placed} "
                  f"LOCATION '{paths[0]}'")
        return table, spark.table(table)
    if not spark.catalog.tableExists(table):
        # The table's own folder holds nothing; every partition has one elsewhere.
        spark.sql(f"CREATE TABLE {table} ({columns}, segment int) USING parquet "
                  f"PARTITIONED BY (segment) {placed} LOCATION '{paths[0]}-and-others'")
        parts = " ".join(f"PARTITION (segment={i}) LOCATION '{p}'" for i, p in enumerate(paths))
        spark.sql(f"ALTER TABLE {table} ADD {parts}")
    # With a condition on partitions the planner looks up the sizes of their files.
    rows = spark.table(table).filter(F.col("segment") >= 0)
    return table, rows.drop("segment") if drop else rows


def _table_name() -> str:
    return f"rankweave_{uuid.uuid4().hex[:12]}"


# The bucketed tables of a build and their order inside a bucket.
BUCKETED = {"forward": "doc_id", "term_doc_stats": "token_id", "token_position": "token_id"}


def summed_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens of several segments or batches. A search joins its words below the sums."""
    return tokens.groupBy("token_id", "token").agg(F.sum("doc_freq").alias("doc_freq"))


def summed_stats(stats: DataFrame) -> DataFrame:
    sums = stats.agg(F.sum("total_docs").alias("total_docs"), F.sum("total_len").alias("total_len"))
    return sums.withColumn("avgdl", F.try_divide(F.col("total_len").cast("double"),
                                                 F.col("total_docs").cast("double")))


def summed_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("token_id", "block").agg(
        F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))


def open_index(spark: SparkSession, path: str, analyzer: Analyzer = words,
               lexicon: DataFrame | None = None) -> LexicalIndex:
    """Open the segments of the last commit at `path`, also of another session.

    Another analyzer or lexicon than the build was made with would rank silently wrong and is
    refused.
    """
    last = last_commit(spark, path)
    given = (analyzer_name(analyzer), lexicon_mark(lexicon))
    if given != (last["analyzer"], last["lexicon"]):
        raise ValueError(f"the index was built with {last['analyzer']}, lexicon {last['lexicon']}, "
                         f"not with {given[0]}, lexicon {given[1]}")
    builds, buckets = [f"{path}/{name}" for name in last["segments"]], last["buckets"]
    names, frames = zip(*[open_table(spark, path, last, name) for name in BUCKETED
                          if name != "token_position" or last["positions"]])
    token, stats, blocks = [
        spark.read.parquet(*[f"{build}/{name}" for build in builds])
        if path_exists(spark, f"{builds[0]}/{name}") else None
        for name in ("token", "corpus_stats", "term_blocks")]
    if len(builds) > 1:
        token, stats, blocks = summed_tokens(token), summed_stats(stats), summed_blocks(blocks)
    return LexicalIndex(
        document=frames[0].drop("tokens"),
        token=token,
        term_doc_stats=frames[1],
        token_position=frames[2] if last["positions"] else _positions(frames[0], lexicon),
        corpus_stats=stats,
        analyzer=analyzer,
        lexicon=lexicon,
        buckets=buckets,
        tables=names,
        term_blocks=blocks,
        blocks=blocks_of(buckets),
    )


def named_postings(index: LexicalIndex, limit: int = BROADCAST_BYTES) -> DataFrame:
    """All postings with `token` and `doc_freq`.

    The tokens are broadcast, or as many of the most frequent ones as stay below the limit: their
    postings are joined where they lie. Only postings of the other tokens, in few documents each,
    are shuffled.
    """
    token, postings = index.token, index.term_doc_stats
    row_bytes = F.octet_length("token").cast("long") + 32
    power = F.floor(F.log2("doc_freq"))
    sizes = dict(token.groupBy(power).agg(F.sum(row_bytes)).collect())
    least, size = None, 0
    for found in sorted(sizes, reverse=True):
        size += sizes[found]
        if size > limit:
            break
        least = 2 ** found
    else:
        return postings.join(F.broadcast(token), "token_id")
    if least is None:
        return postings.join(token, "token_id")
    # Two tokens of one id stay together.
    common = F.broadcast(token.filter(F.col("doc_freq") >= least).select("token_id").distinct())
    here = postings.join(F.broadcast(token.join(common, "token_id", "left_semi")), "token_id")
    rest = postings.join(common, "token_id", "left_anti").join(
        token.filter(F.col("doc_freq") < least), "token_id")
    return here.unionByName(rest)


def close_index(index: LexicalIndex) -> None:
    """Take the index out of the session's catalog; its files stay."""
    for table in index.tables:
        index.document.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")


def validate_index(index: LexicalIndex, links: DataFrame | None = None) -> DataFrame:
    """Violations of the table rules as `(rule, table_name, violations)`; one row per rule.

    Uniqueness and references are checked on narrow, pre-aggregated keys, so a token or document
    with very many rows is reduced before it is shuffled.
    """
    doc, tok, post, pos = (index.document, index.token, index.term_doc_stats,
                           index.token_position)

    def rule(name: str, table: str, bad: DataFrame) -> DataFrame:
        return bad.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(name).alias("rule"), F.lit(table).alias("table_name"), "violations")

    def row_rules(table: str, df: DataFrame, broken: dict[str, str]) -> DataFrame:
        """Rules on single rows, all counted in one pass over the table."""
        counts = df.agg(*[F.count_if(F.expr(condition)).alias(f"v{i}")
                          for i, condition in enumerate(broken.values())])
        return counts.select(F.inline(F.array(*[
            F.struct(F.lit(name).alias("rule"), F.lit(table).alias("table_name"),
                     F.col(f"v{i}").alias("violations")) for i, name in enumerate(broken)])))

    def repeated(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")

    def dangling(df: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
        keys = df.select(F.col(key).alias("_key")).distinct()
        return keys.join(target.select(F.col(target_key).alias("_key")), "_key", "left_anti")

    checks = [
        row_rules("document", doc, {"len >= 0": "len < 0 OR len IS NULL",
                                    "full_text not null": "full_text IS NULL",
                                    "url or title not null": "url IS NULL AND title IS NULL"}),
        rule("doc_id unique", "document", repeated(doc, "doc_id")),
        rule("url unique", "document", repeated(doc.filter("url IS NOT NULL"), "url")),
        rule("token unique", "token", repeated(tok, "token")),
        rule("token_id unique", "token", repeated(tok, "token_id")),
        row_rules("token", tok, {"doc_freq >= 0": "doc_freq < 0"}),
        row_rules("term_doc_stats", post, {"tf >= 0": "tf < 0"}),
        rule("(token_id, doc_id) unique", "term_doc_stats", repeated(post, "token_id", "doc_id")),
        rule("doc_id known", "term_doc_stats", dangling(post, "doc_id", doc, "doc_id")),
        rule("token_id known", "term_doc_stats", dangling(post, "token_id", tok, "token_id")),
        row_rules("token_position", pos, {"position >= 0": "position < 0"}),
        rule("(doc_id, token_id, position) unique", "token_position",
             repeated(pos, "doc_id", "token_id", "position")),
        rule("doc_id known", "token_position", dangling(pos, "doc_id", doc, "doc_id")),
        rule("token_id known", "token_position", dangling(pos, "token_id", tok, "token_id")),
    ]
    if links is not None:
        checks += [
            rule("(from_doc_id, to_doc_id) unique", "link",
                 repeated(links, "from_doc_id", "to_doc_id")),
            rule("from_doc_id known", "link", dangling(links, "from_doc_id", doc, "doc_id")),
            rule("to_doc_id known", "link", dangling(links, "to_doc_id", doc, "doc_id")),
        ]
    result = checks[0]
    for check in checks[1:]:
        result = result.unionByName(check)
    return result
