from dataclasses import replace
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import rows
from rankweave.operators import bm25, legacy, rerank
from rankweave.plans import registry
from rankweave.sources import corpus, index, segments
from rankweave.streaming import ingest

WORDS = "salt tea oak rain stone lamp river wind moss fern".split()


def frame(spark, ids):
    data = [(i, " ".join(["the"] * (i % 4 + 1) + [WORDS[(i * j) % 10] for j in range(1, i % 7 + 2)]
                         + [f"w{i}"]), f"doc://{i}", f"title {i}") for i in ids]
    return spark.createDataFrame(data, "doc_id long, full_text string, url string, title string")


QUERIES = {1: "the salt lamp", 2: "oak w7 w130", 3: "the", 4: "nowhere"}


def same(a, b):
    return sorted(rows(a, *sorted(a.columns)), key=str) == sorted(rows(b, *sorted(a.columns)), key=str)


def size(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grown") / "i")
    index.write_index(frame(spark, range(0, 160)), path, buckets=3)
    for start in range(160, 200, 10):
        idx = segments.add_documents(frame(spark, range(start, start + 10)), path, fanout=3)
    whole = str(tmp_path_factory.mktemp("whole") / "i")
    return path, idx, index.write_index(frame(spark, range(200)), whole, buckets=3)


def test_tables_and_searches_equal_a_rebuild(spark, grown, as_queries):
    path, idx, whole = grown
    assert len(index.last_commit(spark, path)["segments"]) > 1
    for name in ("document", "token", "term_doc_stats", "token_position", "corpus_stats"):
        assert same(getattr(idx, name), getattr(whole, name)), name
    qs = as_queries(QUERIES)
    for prune in (False, True):
        assert same(bm25.bm25_topk(idx, qs, prune=prune, top_k=7),
                    bm25.bm25_topk(whole, qs, prune=False, top_k=7))
    assert same(legacy.legacy_rank(legacy.matched_tokens(idx, qs)),
                legacy.legacy_rank(legacy.matched_tokens(whole, qs)))
    wanted = spark.createDataFrame([(1, 5), (1, 165), (2, 199), (2, 999)], "query_id long, doc_id long")
    assert same(rerank.fetch_documents(wanted, idx.document),
                rerank.fetch_documents(wanted, whole.document))
    assert all(r["violations"] == 0 for r in index.validate_index(idx).collect())


def test_scores_are_added_up_without_a_shuffle_of_postings(spark, grown, as_queries):
    idx = grown[1]
    part, terms = bm25._term_chunks(idx, as_queries(QUERIES), "set", 1 << 20)[0]
    plan = bm25.bm25_scores(part, terms, 1.5, 0.75)._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("BroadcastExchange")] if "BroadcastExchange" in plan else plan
    assert "Exchange hashpartitioning" not in above and "Bucketed: true" in plan


def test_rows_by_block_of_segments_are_whole_or_missing(spark, grown):
    path = grown[0]
    seen = {}
    for name in index.last_commit(spark, path)["segments"]:
        blocks = spark.read.parquet(f"{path}/{name}/term_blocks").groupBy("token_id").agg(
            F.max("block").alias("b"))
        for token, most in rows(blocks, "token_id", "b"):
            seen.setdefault(token, set()).add(most != index.ALL_BLOCKS)
    assert all(len(kinds) == 1 for kinds in seen.values())


def test_an_addition_writes_what_it_adds(spark, tmp_path):
    path = str(tmp_path / "i")
    index.write_index(frame(spark, range(4000)), path, buckets=1)
    first = {f: f.stat().st_mtime_ns for f in Path(path).glob("build-*/**/*.parquet")}
    before = set(Path(path).glob("build-*"))
    segments.add_documents(frame(spark, range(4000, 4040)), path)
    assert all(f.stat().st_mtime_ns == t for f, t in first.items())
    added, = set(Path(path).glob("build-*")) - before
    assert spark.read.parquet(f"{added}/forward").count() == 40
    # A hundredth of the rows, beside what every segment takes, such as footers and filters.
    before.add(added)
    segments.add_documents(frame(spark, [5000]), path)
    least, = set(Path(path).glob("build-*")) - before
    assert size(added) - size(least) < 0.03 * sum(f.stat().st_size for f in first)


def test_known_documents_are_left_out(spark, tmp_path):
    path = str(tmp_path / "i")
    index.write_index(frame(spark, range(5)), path, buckets=2)
    segments.add_documents(frame(spark, range(3, 5)), path)
    assert len(index.last_commit(spark, path)["segments"]) == 1
    again = frame(spark, [1, 7]).union(
        frame(spark, [8]).withColumn("url", F.lit("doc://2"))).union(
        frame(spark, [9]).withColumn("url", F.lit(None).cast("string")))
    idx = segments.add_documents(again, path)
    assert sorted(rows(idx.document, "doc_id")) == [(0,), (1,), (2,), (3,), (4,), (7,), (9,)]
    assert rows(idx.document.filter("doc_id = 1"), "full_text") == rows(
        frame(spark, [1]), "full_text")
    with pytest.raises(ValueError, match="built with"):
        segments.add_documents(again, path, lexicon=spark.createDataFrame(
            [("a", "b")], "form string, lemma string"))


def test_full_tier():
    assert segments.full_tier({"a": 1000, "b": 1, "c": 2, "d": 2}, 3) == ["b", "c", "d"]
    assert segments.full_tier({"a": 900, "b": 950, "c": 1}, 2) == ["a", "b"]
    assert segments.full_tier({"a": 900, "b": 3}, 2) == []


def test_merging_keeps_the_rows_and_few_segments(spark, tmp_path, as_queries):
    path = str(tmp_path / "i")
    old = index.write_index(frame(spark, range(4)), path, buckets=2)
    for i in range(4, 9):
        idx = segments.add_documents(frame(spark, [i]), path, fanout=2)
        assert len(index.last_commit(spark, path)["segments"]) <= 6
    whole = index.build_index(frame(spark, range(9)))
    for name in ("document", "token", "term_doc_stats", "token_position", "corpus_stats"):
        assert same(getattr(idx, name), getattr(whole, name)), name
    merged = segments.merge_segments(spark, path, index.last_commit(spark, path)["segments"])
    assert index.last_commit(spark, path)["segments"] == [merged]
    # One file to a bucket, and a session that has the first build open keeps it.
    assert len(list(Path(f"{path}/{merged}/forward").glob("*.parquet"))) <= 2
    assert old.document.count() == 4
    assert len(segments.remove_dead(spark, path)) > 0
    assert [p.name for p in Path(path).glob("build-*")] == [merged]
    idx = index.open_index(spark, path)
    assert same(bm25.bm25_topk(idx, as_queries(QUERIES)), bm25.bm25_topk(whole, as_queries(QUERIES)))


BATCHES = [
    [(1, "a", "<title>A</title><p>salt tea</p>"), (2, "b", "<p>oak</p>"), (3, "b", "<p>late</p>")],
    [(4, "b", "<p>later</p>"), (5, None, "<p>no url</p>"), (6, "c", None)],
    [(7, "a", "<p>again</p>")],
    [(8, "d", "<p>salt salt</p>"), (9, "c", "<p>fern</p>")],
]
PAGES = "page_id long, url string, html string"


def test_stream_of_segments_equals_a_batch(spark, tmp_path):
    path, source = str(tmp_path / "i"), str(tmp_path / "in")
    for number, batch in enumerate(BATCHES):
        spark.createDataFrame(batch, PAGES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(PAGES).parquet(source)
        ingest.stream_segments(stream, path, str(tmp_path / "checkpoint"), buckets=2,
                               fanout=2).awaitTermination()
    last = index.last_commit(spark, path)
    assert last["batch"] == 3
    everything = spark.createDataFrame([row for batch in BATCHES for row in batch], PAGES)
    whole = index.build_index(corpus.ingest_pages(everything))
    idx = index.open_index(spark, path)
    for name in ("document", "token", "term_doc_stats", "token_position", "corpus_stats"):
        assert same(getattr(idx, name), getattr(whole, name)), name
    # A batch that runs again changes nothing.
    for number in (3, 0):
        ingest.add_segment(spark.createDataFrame(BATCHES[number], PAGES), number, path)
    assert index.last_commit(spark, path) == last


def test_an_empty_first_batch_and_one_lost_before_its_commit(spark, tmp_path):
    path = str(tmp_path / "i")
    ingest.add_segment(spark.createDataFrame([], PAGES), 0, path)
    assert not Path(path).exists()
    pages = spark.createDataFrame(BATCHES[0], PAGES)
    ingest.add_segment(pages, 1, path, buckets=2)
    ingest.add_segment(spark.createDataFrame([], PAGES), 2, path)
    # A segment without a manifest row is never seen.
    lost = spark.createDataFrame(BATCHES[3], PAGES)
    index.write_forward(corpus.ingest_pages(lost), index.new_build(path), buckets=2)
    assert index.open_index(spark, path).document.count() == 2
    ingest.add_segment(lost, 3, path)
    assert index.open_index(spark, path).document.count() == 4
    assert len(segments.remove_dead(spark, path)) == 1
    assert index.open_index(spark, path).document.count() == 4


@pytest.mark.parametrize("removing", [True, False])
def test_what_was_merged_goes_step_by_step(spark, tmp_path, monkeypatch, removing):
    path = str(tmp_path / "i")
    index.write_index(frame(spark, range(60)), path, buckets=6)
    segments.add_documents(frame(spark, range(60, 120)), path, fanout=9)
    whole = index.build_index(frame(spark, range(120)))
    names = index.last_commit(spark, path)["segments"]
    save, seen = segments._save_buckets, []

    def files():
        return {kind: len(list(Path(path).glob(f"build-*/{kind}/*.parquet")))
                for kind in index.BUCKETED}

    def failing(rows_, target, *args, **options):
        seen.append((Path(target).name, *files().values()))
        save(rows_, target, *args, **options)
        # What was written last is not committed.
        if len(seen) == 4:
            raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(segments, "_save_buckets", failing)
        if not removing:
            m.setattr(segments, "remove_dead", lambda *_: [])
        with pytest.raises(KeyboardInterrupt):
            segments.merge_segments(spark, path, names, keep_dead=False)
    # Four tasks at a time take four buckets, then two; what is merged goes before the next are.
    assert [name for name, *_ in seen] == ["forward"] * 2 + ["term_doc_stats"] * 2
    if removing:
        assert [counts for _, *counts in seen] == [
            [12, 12, 12], [8, 12, 12], [6, 12, 12], [6, 8, 12]]
    with pytest.raises(ValueError, match="finished first"):
        segments.merge_segments(spark, path, names)
    # A reader finds every row, and the next addition goes on where the merge ended.
    for opened in (lambda: index.open_index(spark, path), lambda: segments.add_documents(
            frame(spark, range(120)), path, fanout=9, keep_dead=False)):
        idx = opened()
        for name in ("document", "token", "term_doc_stats", "token_position", "corpus_stats"):
            assert same(getattr(idx, name), getattr(whole, name)), name
    last = index.last_commit(spark, path)
    assert [p.name for p in Path(path).glob("build-*")] == last["segments"] and len(names) == 2
    assert last["merging"] is None and set(files().values()) == {6}
    # Rows of a bucket are in order, and lookups by id have their filters.
    file = next(Path(path).glob("build-*/forward/*.zstd.parquet"))
    ids = [r["doc_id"] for r in spark.read.parquet(str(file)).select("doc_id").collect()]
    assert ids == sorted(ids)
    column = pq.ParquetFile(file).metadata.row_group(0).column(0)
    assert (column.path_in_schema, column.compression) == ("doc_id", "ZSTD")


def test_postings_are_named_with_and_without_a_shuffle(spark, grown):
    idx = grown[1]
    # Another token of the same id, rare beside a frequent one.
    the = idx.token.filter("token = 'the'").first()["token_id"]
    twin = spark.createDataFrame([(the, "twin", 1)], idx.token.schema)
    idx = replace(idx, token=idx.token.unionByName(twin))
    joined = idx.term_doc_stats.join(idx.token, "token_id")
    for limit in (0, 300, 1 << 20):
        assert same(index.named_postings(idx, limit), joined), limit
    plan = index.named_postings(grown[2])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_an_addition_in_four_arrivals_leaves_one_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"the w{i} oak", f"s{i % 3}") for i in range(400)],
                                 "doc_id long, text string, source string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    shared = Path(spark.conf.get("spark.checkpoint.dir"), "rankweave")
    before = set(shared.glob("index-*"))
    steps = set(shared.glob("blocks-*")) | set(shared.glob("fine-*"))
    found = registry.q_add_documents(spark, str(tmp_path))
    assert found.count() == 1200
    assert rows(found.filter("token = 'oak'").select("doc_freq").distinct()) == [(400,)]
    # Nothing of the merged segments and of the steps to their bounds stays.
    path, = set(shared.glob("index-*")) - before
    assert {p.name for p in path.glob("build-*")} == set(
        index.last_commit(spark, str(path))["segments"])
    assert set(shared.glob("blocks-*")) | set(shared.glob("fine-*")) <= steps
