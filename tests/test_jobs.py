import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import rows
from rankweave.operators import bm25, embed, evaluate
from rankweave.plans import embedding_jobs, evaluation
from rankweave.sources import corpus, index
from rankweave.streaming import ingest

# The model functions below run in tasks, which cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NO_WAIT = embed.EmbedPolicy(batch_size=4, max_tries=3, delay=0.0)


def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, full_text string")


def lengths(texts):
    return [[float(len(t)), 1.0] for t in texts]


def test_embed_keeps_order_and_normalizes(spark):
    found = embed.embed_documents(docs(spark, {i: "x" * i for i in range(10)}), lengths, dims=2)
    for i, v in rows(found, "doc_id", "embedding"):
        assert v == pytest.approx([i / (i * i + 1) ** .5, 1 / (i * i + 1) ** .5], abs=1e-6)
    raw = embed.embed_documents(docs(spark, {3: None}), lengths, normalize=False)
    assert raw.first()["embedding"] == [0.0, 1.0]
    zero = embed.embed_documents(docs(spark, {3: "a"}), lambda t: [[0.0, 0.0]] * len(t))
    assert zero.first()["embedding"] == [0.0, 0.0]


@pytest.mark.parametrize("model,reason", [
    (lambda t: [[1.0]] * (len(t) + 1), "2 vectors for 1 texts"),
    (lambda t: [[1.0]] * len(t), "width 1 instead of 2"),
])
def test_embed_contract(spark, model, reason):
    found = embed.embed_documents(docs(spark, {1: "a"}), model, dims=2, policy=NO_WAIT)
    row = found.first()
    assert row["embedding"] is None and reason in row["embed_error"]
    with pytest.raises(ValueError):
        embed.embed_documents(docs(spark, {1: "a"}), model, dims=0)


def test_only_the_refused_text_gets_an_error(spark):
    def model(texts):
        if "bad" in texts:
            raise ValueError("no")
        return lengths(texts)
    texts = {i: "bad" if i == 5 else f"text {i}" for i in range(12)}
    found = embed.embed_documents(docs(spark, texts).coalesce(1), model, policy=NO_WAIT)
    assert rows(found.filter("embedding IS NULL"), "doc_id", "embed_error") == [(5, "no")]
    whole = embed.embed_documents(docs(spark, texts).coalesce(1), model,
                                  policy=embed.EmbedPolicy(4, 1, 0.0, bisect=False))
    assert whole.filter("embedding IS NULL").count() == 4


def test_backoff():
    waits, calls = [], []

    def model(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise embed.TransientModelError("busy")
        return lengths(texts)
    found = embed.embed_with_policy(model, ["a", "b"], 2, False, embed.EmbedPolicy(),
                                    sleep=waits.append)
    assert [list(v) for v, _ in found] == [[1.0, 1.0]] * 2
    assert waits == [2.0, 4.0] and calls == [2, 2, 2]

    def busy(texts):
        raise embed.TransientModelError("busy")
    with pytest.raises(embed.TransientModelError):
        embed.embed_with_policy(busy, ["a"], 2, False, embed.EmbedPolicy(max_tries=2),
                                sleep=lambda s: None)
    with pytest.raises(ValueError):
        embed.EmbedPolicy(batch_size=0)


def test_backfill_touches_pending_rows_only(spark):
    rows_ = [(1, "a", [5.0, 0.0]), (2, "bb", None), (3, None, None)]
    table = spark.createDataFrame(rows_, "doc_id long, full_text string, embedding array<float>")

    def model(texts):
        assert "a" not in texts
        return lengths(texts)
    found = embedding_jobs.backfill_embeddings(table, model, 2)
    assert {i: v for i, v in rows(found, "doc_id", "embedding")} == {
        1: [5.0, 0.0], 2: pytest.approx([2 / 5 ** .5, 1 / 5 ** .5]), 3: [0.0, 1.0]}
    assert "Exchange" not in found._jdf.queryExecution().toString()
    audit = embed.embedding_audit(table).first()
    assert tuple(audit) == (3, 2, 2, 2)


def test_backfill_resumes_without_a_second_call(spark, tmp_path):
    source, target, log = str(tmp_path / "docs"), str(tmp_path / "out"), tmp_path / "log"
    log.mkdir()
    for part in range(3):
        data = [(part * 10 + i, f"text {part} {i}", [1.0, 2.0] if i == 0 else None) for i in range(3)]
        spark.createDataFrame(data, "doc_id long, full_text string, embedding array<double>") \
            .coalesce(1).write.mode("append").parquet(source)

    def model(texts, broken):
        import os
        import uuid
        for text in texts:
            if broken and text.startswith("text 1"):
                raise embed.TransientModelError("down")
            open(os.path.join(str(log), f"{text}-{uuid.uuid4().hex}"), "w").close()
        return lengths(texts)

    run = lambda broken, **kw: embedding_jobs.backfill_files(
        spark, source, target, lambda t: model(t, broken),
        **{"model": "m", "dims": 2, "files_per_step": 1, "policy": embed.EmbedPolicy(20, 1, 0.0), **kw})
    with pytest.raises(Exception):
        run(True)
    done = run(False)
    assert {i: v for i, v in rows(done, "doc_id", "embedding") if i % 10 == 0} == {
        0: [1.0, 2.0], 10: [1.0, 2.0], 20: [1.0, 2.0]}
    assert done.count() == 9 and done.filter("embedding IS NULL").count() == 0
    # Each pending text was sent once, the stored ones never, and another call sends none.
    assert sorted(p.name.split("-")[0] for p in log.iterdir()) == [
        f"text {p} {i}" for p in range(3) for i in (1, 2)]
    assert run(False).count() == 9 and len(list(log.iterdir())) == 6
    with pytest.raises(ValueError, match="does not match"):
        run(False, dims=3)


@pytest.mark.parametrize("folder", [False, True])
def test_reembed_query_reads_a_table_of_one_or_many_files(spark, tmp_path, folder):
    import shutil

    from rankweave.plans import registry
    given = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    given.repartition(3 if folder else 1).write.parquet(str(tmp_path / "written"))
    table = tmp_path / "documents.parquet"
    if folder:
        shutil.copytree(tmp_path / "written", table)
    else:
        shutil.copy(next((tmp_path / "written").glob("part-*.parquet")), table)
    done = registry.q_reembed_documents(spark, str(tmp_path))
    assert sorted(r[0] for r in done.select("doc_id").distinct().collect()) == list(range(6))
    assert done.count() == 6 * registry.DIMS


def test_reembed_resumes_behind_the_last_finished_step(spark, tmp_path):
    source, target = str(tmp_path / "docs"), str(tmp_path / "out")
    for part in range(4):
        docs(spark, {part * 10 + i: f"text {part}" for i in range(3)}).coalesce(1).write.mode(
            "append").parquet(source)
    log = tmp_path / "log"
    log.mkdir()

    def model(texts, broken):
        import os
        import uuid
        for text in texts:
            if broken and text == "text 2":
                raise embed.TransientModelError("down")
            open(os.path.join(str(log), f"{text}-{uuid.uuid4().hex}"), "w").close()
        return lengths(texts)

    run = lambda broken, **kw: embedding_jobs.reembed_documents(
        spark, source, target, lambda t: model(t, broken),
        **{"model": "m", "dims": 2, "confirm": True, "files_per_step": 1,
           "policy": embed.EmbedPolicy(20, 1, 0.0), **kw})
    with pytest.raises(ValueError, match="confirm"):
        run(False, confirm=False)
    with pytest.raises(Exception):
        run(True)
    before = len(list(log.iterdir()))
    assert before < 12
    done = run(False)
    assert sorted(rows(done, "doc_id")) == [(p * 10 + i,) for p in range(4) for i in range(3)]
    # Every text was sent once; running again sends none.
    assert len(list(log.iterdir())) == 12
    assert run(False).count() == 12 and len(list(log.iterdir())) == 12
    with pytest.raises(ValueError, match="does not match"):
        run(False, dims=3)
    docs(spark, {99: "new"}).write.mode("append").parquet(source)
    with pytest.raises(ValueError, match="does not match"):
        run(False)


def test_evaluation_resumes(make_index, as_queries, tmp_path):
    idx = make_index({i: f"w{i % 3} x" for i in range(9)})
    queries = as_queries({i: f"w{i % 3}" for i in range(12)})
    path, calls = str(tmp_path / "run"), []

    def retrieve(qs, fail_at=None):
        calls.append(len(calls))
        if len(calls) == fail_at:
            raise RuntimeError("stopped")
        return bm25.bm25_topk(idx, qs, top_k=2)
    config = {"top_k": 2, "k1": 1.5}
    with pytest.raises(RuntimeError):
        evaluation.resume_run(queries, lambda q: retrieve(q, 3), path, config, 4)
    assert len(calls) == 3
    found = evaluation.resume_run(queries, retrieve, path, config, 4)
    assert len(calls) == 5  # the two slices not finished before
    assert sorted(rows(found, "query_id", "doc_id", "rank")) == sorted(
        rows(bm25.bm25_topk(idx, queries, top_k=2), "query_id", "doc_id", "rank"))
    more = as_queries({i: f"w{i % 3}" for i in range(20)})
    found = evaluation.resume_run(more, retrieve, path, config, 4)
    assert len(calls) <= 9 and found.select("query_id").distinct().count() == 20
    done = len(calls)
    assert evaluation.resume_run(queries, retrieve, path, config, 2).count() == 24
    assert len(calls) == done
    with pytest.raises(ValueError, match="does not match"):
        evaluation.resume_run(queries, retrieve, path, {**config, "top_k": 20}, 4)


def test_four_modes_resume_behind_the_last_finished_step(make_index, as_queries, tmp_path):
    idx = make_index({i: f"w{i % 3} x" for i in range(9)})
    queries = as_queries({i: f"w{i % 3}" for i in range(12)})
    path, calls = str(tmp_path / "modes"), []

    def retriever(name, fail_at=None):
        def retrieve(qs):
            calls.append((name, tuple(sorted(r[0] for r in rows(qs, "query_id")))))
            return bm25.attach_titles(bm25.bm25_topk(idx, qs, top_k=3), idx.document)
        return retrieve

    def ranker(stop):
        def rank(qs, candidates):
            calls.append(("rank", tuple(sorted(r[0] for r in rows(qs, "query_id")))))
            if stop:
                raise RuntimeError("stopped")
            return candidates.filter("rank <= 2")
        return rank

    def run(stop, some=queries, **more):
        return evaluation.resume_modes(some, retriever("bm25"), retriever("vector"), ranker(stop),
                                       path, {"k": 3, **more}, pool=3, slices=3)
    with pytest.raises(RuntimeError):
        run(True)
    assert [name for name, _ in calls] == ["bm25", "vector", "rank"]
    found, times = run(False)
    # Nothing is asked twice but the step that was stopped.
    assert sorted(set(calls)) == sorted(calls[:2] + calls[3:])
    assert {name: sum(len(q) for n, q in calls if n == name) for name in ("bm25", "vector")} == {
        "bm25": 12, "vector": 12}
    plain = evaluation.compare_modes(queries, retriever("x"), retriever("x"), ranker(False), pool=3)
    columns = ("mode", "query_id", "doc_id", "rank")
    assert sorted(rows(found, *columns)) == sorted(rows(plain, *columns))
    told = rows(times, "mode", "queries", "seconds")
    assert len(told) == 4 * 3 and all(s > 0 for _, _, s in told)
    assert sum(n for mode, n, _ in told if mode == "rrf") == 12
    summary = rows(evaluate.latency_summary(times), "mode", "n")
    assert sorted(summary) == sorted((mode, 3) for mode in evaluation.MODES)
    done = len(calls)
    assert run(False)[0].count() == found.count() and len(calls) == done
    more = as_queries({i: f"w{i % 3}" for i in range(15)})
    assert run(False, more)[0].select("query_id").distinct().count() == 15
    with pytest.raises(ValueError, match="does not match"):
        run(False, k1=2.0)


PAGES = "page_id long, url string, html string"
BATCHES = [
    [(1, "u1", "<title>One</title><p>apple apple pear</p>"), (2, "u2", "<p>pear</p>"),
     (3, "u1", "<p>late copy</p>"), (4, None, "<p>kiwi</p>"), (5, "u5", None)],
    [(6, "u2", "<p>known url</p>"), (7, "u7", "<p>apple</p>"), (8, None, "<p>kiwi</p>")],
]


def tables(idx):
    out = {}
    for name in ("document", "token", "term_doc_stats", "token_position", "corpus_stats"):
        df = getattr(idx, name)
        out[name] = sorted(rows(df, *sorted(set(df.columns) - {"arrival"})), key=str)
    return out


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "stream")
    for i, batch in enumerate(BATCHES):
        ingest.add_batch(spark.createDataFrame(batch, PAGES), i, path)
    streamed = tables(ingest.read_stream_index(spark, path))
    everything = spark.createDataFrame(sum(BATCHES, []), PAGES)
    batch = index.write_index(corpus.ingest_pages(everything), str(tmp_path / "batch"))
    assert streamed == tables(batch)
    assert len(streamed["document"]) == 5
    for i in (1, 0, 1):
        ingest.add_batch(spark.createDataFrame(BATCHES[i], PAGES), i, path)
    assert tables(ingest.read_stream_index(spark, path)) == streamed
    assert all(r["violations"] == 0 for r in index.validate_index(
        ingest.read_stream_index(spark, path)).filter(
        "rule <> 'url or title not null'").collect())
    compacted = ingest.compact(spark, path, str(tmp_path / "compact"))
    assert tables(compacted) == streamed


def test_streaming_query_over_files(spark, tmp_path, as_queries):
    source, path = str(tmp_path / "in"), str(tmp_path / "index")
    schema = spark.createDataFrame([], PAGES).schema
    for batch in BATCHES:
        spark.createDataFrame(batch, PAGES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.stream_ingest(stream, path, str(tmp_path / "checkpoint")).awaitTermination()
    idx = ingest.read_stream_index(spark, path)
    assert idx.corpus_stats.first()["total_docs"] == 5
    found = bm25.bm25_topk(idx, as_queries({1: "apple"}))
    top = found.join(idx.document, "doc_id").orderBy("rank")
    assert rows(top, "url", "rank") == [("u1", 1), ("u7", 2)] or \
        rows(top, "url", "rank") == [("u7", 1), ("u1", 2)]
    assert found.select(F.countDistinct("doc_id")).first()[0] == 2
    # Document counts are summed for the words of the query only: the join is below the sum.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    after_sum = plan[plan.index("sum(doc_freq"):]
    assert "LeftSemi" in after_sum


def test_hashing_embedder_hashes_a_word_once_for_many_batches(monkeypatch):
    hashed = []
    md5 = embed.hashlib.md5
    monkeypatch.setattr(embed.hashlib, "md5", lambda data: hashed.append(data) or md5(data))
    run = embed.hashing_embedder(8)
    texts = ["A b a", "", "_ b", "c-C é"]
    found = [run([text])[0].tolist() for text in texts]
    assert sorted(hashed) == [b"a", b"b", b"c", "é".encode()]
    for text, vector in zip(texts, found):
        expected = [0.0] * 8
        for word in embed.re.findall(r"[^\W_]+", text.lower()):
            digest = md5(word.encode()).hexdigest()
            expected[int(digest[:8], 16) % 8] += -1 if digest[8] >= "8" else 1
        assert vector == expected
