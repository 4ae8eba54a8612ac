"""Adding documents to a written index.

New documents become a segment of their own, with the buckets of the index, which is written once and
never changed; the manifest tells which segments are live. What an addition writes follows from what
it adds. A search sees a bucket of all segments in one task, so it needs no shuffle more than in an
index of one segment; frequencies and bounds of tokens are added up for the words that it asks for.

When `fanout` segments of a similar size have come together they are merged into one of the next
size, table by table and bucket by bucket: texts are not analyzed again and rows stay in their
buckets. So a document is rewritten once for each size, and there are at most `fanout - 1` segments
of any size. Segments that are no longer live stay for sessions which have them open, until
`remove_dead` is called. Where no other session has the index open, `keep_dead=False` removes them at
once: a merge then commits some buckets of a table at a time and removes what it has merged, so beside
the index there is a part of one table at most.

One writer at a time: two additions at once would each commit without the other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import log

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import Analyzer, words
from ..session import materialize, picked, settings, union_all
from .index import (
    BUCKETED, FORWARD_OPTIONS, LexicalIndex, _save_buckets, _save_tokens, commit, derive_index,
    last_commit, new_build, open_buckets, open_index, summed_stats, summed_tokens, table_of,
    write_blocks, write_forward,
)

FANOUT = 8
# A merge that removes what it has merged takes the buckets of a table in so many steps, or in more
# of so many buckets, but not in steps that leave cores without one.
MERGE_STEPS = 4
MOST_BUCKETS_OF_A_STEP = 64


def unknown_documents(documents: DataFrame, index: LexicalIndex,
                      urls: bool = True) -> DataFrame:
    """Documents whose id, and url, the index does not have.

    Both are looked up: ids in their buckets, which are sorted by them, urls by their filters.
    Without `urls` only ids are, which is enough where ids follow from urls.
    """
    fresh = documents
    for key in ("doc_id", "url") if urls else ("doc_id",):
        known = materialize(picked(index.document.select(key), key, documents).distinct(), "known")
        fresh = fresh.join(known, key, "left_anti")
    return fresh.select(*documents.columns)


def add_documents(documents: DataFrame, path: str, analyzer: Analyzer = words,
                  lexicon: DataFrame | None = None, fanout: int = FANOUT, urls: bool = True,
                  batch: int | None = None, keep_dead: bool = True) -> LexicalIndex:
    """Add `doc_id, full_text, url, title` to the index at `path`, and open it.

    A document with an id or url that the index has already is left out, so adding again changes
    nothing. `doc_id` and `url` are unique in `documents`, as for `write_index`. With `batch`, a
    batch of a stream up to the last one that was added is not added again. Without `keep_dead`
    merged segments go at once, and with them what sessions that have the index open read.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    spark = documents.sparkSession
    finish_merge(spark, path)
    index = open_index(spark, path, analyzer, lexicon)
    last = last_commit(spark, path)
    if batch is None:
        batch = last["batch"]
    elif last["batch"] is not None and batch <= last["batch"]:
        return index
    fresh = unknown_documents(documents, index, urls)
    if fresh.isEmpty():
        return index
    build = new_build(path)
    write_forward(fresh, build, analyzer, last["buckets"])
    derive_index(spark, path, build, last["buckets"], analyzer, lexicon, last["positions"],
                 last["segments"], batch)
    while merge_tier(spark, path, fanout, keep_dead):
        pass
    return open_index(spark, path, analyzer, lexicon)


def segment_sizes(spark: SparkSession, path: str, names: list[str]) -> dict[str, int]:
    """Tokens of each segment."""
    stats = spark.read.parquet(*[f"{path}/{name}/corpus_stats" for name in names])
    segment = F.regexp_extract("_metadata.file_path", "/(build-[0-9a-f]+)/corpus_stats/", 1)
    return {r[0]: r[1] or 0 for r in stats.select(segment, "total_len").collect()}


def full_tier(sizes: dict[str, int], fanout: int) -> list[str]:
    """The smallest segments of a similar size, if there are as many as are merged."""
    tiers: dict[int, list[str]] = {}
    for name, size in sizes.items():
        tiers.setdefault(int(log(max(size, 1), fanout) + 1e-9), []).append(name)
    full = [tier for tier in sorted(tiers) if len(tiers[tier]) >= fanout]
    return sorted(tiers[full[0]]) if full else []


def merge_tier(spark: SparkSession, path: str, fanout: int = FANOUT,
               keep_dead: bool = True) -> bool:
    """Merge the smallest full tier, if there is one."""
    last = last_commit(spark, path)
    names = full_tier(segment_sizes(spark, path, last["segments"]), fanout)
    if names:
        merge_segments(spark, path, names, keep_dead)
    return bool(names)


def finish_merge(spark: SparkSession, path: str) -> None:
    """Go on with a merge that was interrupted after a part of it was committed."""
    merging = last_commit(spark, path)["merging"]
    if merging:
        merge_segments(spark, path, merging["names"], keep_dead=False)


def merge_segments(spark: SparkSession, path: str, names: list[str],
                   keep_dead: bool = True) -> str:
    """Put one segment in the place of the named ones; its name.

    Without `keep_dead` buckets that are done take the place of those they were made of, which are
    removed.
    """
    last = last_commit(spark, path)
    merging = last["merging"]
    if merging and (merging["names"] != names or keep_dead):
        raise ValueError(f"the merge of {merging['names']} has to be finished first")
    build = f"{path}/{merging['build']}" if merging else new_build(path)
    name, buckets = build.rsplit("/", 1)[-1], last["buckets"]
    others = [other for other in last["segments"] if other not in names]
    done = merging["done"] if merging else {}

    def put(live: list[str], under_way: tuple | None = None) -> None:
        commit(spark, path, live, buckets, last["positions"], last["analyzer"], last["lexicon"],
               last["batch"], under_way)
        if not keep_dead:
            remove_dead(spark, path)

    for kind in BUCKETED:
        if kind == "token_position" and not last["positions"]:
            continue
        paths = [f"{path}/{merged}/{kind}" for merged in names]
        if keep_dead:
            merge_table(spark, paths, f"{build}/{kind}", buckets)
            continue
        for end in merge_steps(spark, paths, f"{build}/{kind}", buckets, done.get(kind, 0)):
            done = {**done, kind: end}
            put(last["segments"], (name, names, done))

    def all_rows(kind: str) -> DataFrame:
        return spark.read.parquet(*[f"{path}/{merged}/{kind}" for merged in names])

    _save_tokens(summed_tokens(all_rows("token")), f"{build}/token")
    (summed_stats(all_rows("corpus_stats")).write.mode("overwrite")
     .parquet(f"{build}/corpus_stats"))
    write_blocks(spark, path, build, buckets, others)
    put([*others, name])
    return name


def _options(target: str) -> dict[str, str] | None:
    return FORWARD_OPTIONS if target.endswith("/forward") else None


def merge_table(spark: SparkSession, paths: list[str], target: str, buckets: int) -> None:
    """Merge the files of a table bucket by bucket."""
    order = BUCKETED[target.rsplit("/", 1)[-1]]
    # A task reads one bucket of all segments and writes one file, though nothing else asks for it.
    with settings(spark, {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}):
        in_use = spark.catalog.tableExists(table_of(paths))
        table, rows = open_buckets(spark, paths, buckets, order)
        _save_buckets(rows, target, buckets, order, _options(target))
        if not in_use:
            spark.sql(f"DROP TABLE {table}")


def merge_steps(spark: SparkSession, paths: list[str], target: str, buckets: int,
                done: int) -> Iterator[int]:
    """Merge the files of a table some buckets at a time; how many are done after each step."""
    if done == buckets:
        return
    order = BUCKETED[target.rsplit("/", 1)[-1]]
    schema = spark.read.parquet(*paths).schema
    # Of a step that was interrupted.
    remove_buckets(spark, target, lambda bucket: bucket >= done)
    step = max(spark.sparkContext.defaultParallelism,
               min(-(-buckets // MERGE_STEPS), MOST_BUCKETS_OF_A_STEP))
    while done < buckets:
        end = min(done + step, buckets)
        files: dict[int, list[str]] = {}
        for path in paths:
            for file, bucket in bucket_files(spark, path):
                if done <= bucket < end:
                    files.setdefault(bucket, []).append(file)
        if files:
            # One task to a bucket. A union would put those of one partition each into one.
            with settings(spark, {"spark.sql.unionOutputPartitioning": "false"}):
                rows = union_all([spark.read.schema(schema).parquet(*found).coalesce(1)
                                  for found in files.values()])
                _save_buckets(rows, target, buckets, order, _options(target), append=True)
        done = end
        yield done


def bucket_files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """The files of a bucketed table and their buckets, which Spark puts behind their names."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(root)]
    found = [(name, re.search(r"_(\d+)\.c\d+\.[\w.]*$", name)) for name in names]
    return [(f"{folder}/{name}", int(match[1])) for name, match in found if match]


def remove_buckets(spark: SparkSession, folder: str, dead: Callable[[int], bool]) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for file, bucket in bucket_files(spark, folder):
        if dead(bucket):
            fs.delete(path(file), False)


def remove_dead(spark: SparkSession, path: str) -> list[str]:
    """Remove the segments that are not live, and of a merge under way the buckets that it has done;
    call it when no session reads them. The names of the segments."""
    last = last_commit(spark, path)
    merging = last["merging"] or {"build": None, "names": [], "done": {}}
    live = {*last["segments"], merging["build"]}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [status.getPath().getName() for status in fs.listStatus(root)]
    dead = [name for name in found if name.startswith("build-") and name not in live]
    for name in dead:
        fs.delete(hadoop.Path(f"{path}/{name}"), True)
    for kind, done in merging["done"].items():
        for name in merging["names"]:
            remove_buckets(spark, f"{path}/{name}/{kind}", lambda bucket: bucket < done)
    return sorted(dead)
