import pytest
from pyspark.sql import functions as F

from conftest import rows
from rankweave.functions.text import ascii_words, words
from rankweave.operators import bm25, lexical
from rankweave.session import lookup_join, scratch_dir
from rankweave.sources import corpus, index

TEXTS = {1: "Banana bread, banana!", 2: "Vector search", 3: "", 4: "search the database search"}


def test_tables(make_index):
    idx = make_index(TEXTS)
    assert dict(rows(idx.document, "doc_id", "len")) == {1: 3, 2: 2, 3: 0, 4: 4}
    assert dict(rows(idx.token, "token", "doc_freq")) == {
        "banana": 1, "bread": 1, "vector": 1, "search": 2, "the": 1, "database": 1}
    stats = idx.corpus_stats.first()
    assert (stats["total_docs"], stats["avgdl"]) == (4, 9 / 4)
    # The terms of a document add up to its length, and a token's postings to its frequency.
    tf = dict(rows(idx.term_doc_stats.groupBy("doc_id").agg(F.sum("tf"))))
    assert tf == {1: 3, 2: 2, 4: 4}
    per_token = idx.term_doc_stats.groupBy("token_id").count()
    assert per_token.join(idx.token, "token_id").filter("count <> doc_freq").count() == 0
    assert idx.token_position.count() == 9


def test_open_index_from_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a", "u", "t")],
                                 "doc_id long, full_text string, url string, title string")
    index.write_index(docs, str(tmp_path / "i"))
    again = index.open_index(spark, str(tmp_path / "i"))
    assert sorted(rows(again.term_doc_stats, "doc_id", "tf")) == [(1, 1), (1, 2)]
    # Writing again replaces the index.
    index.write_index(docs.withColumn("full_text", F.lit("c")), str(tmp_path / "i"))
    assert rows(index.open_index(spark, str(tmp_path / "i")).token, "token") == [("c",)]


def test_planned_index_equals_written_one(spark, make_index):
    written = make_index(TEXTS)
    planned = index.build_index(written.document.select("doc_id", "full_text", "url", "title"))
    for name in ("document", "token", "term_doc_stats", "token_position", "corpus_stats"):
        a, b = getattr(written, name), getattr(planned, name)
        assert sorted(rows(a, *sorted(a.columns)), key=str) == sorted(
            rows(b, *sorted(a.columns)), key=str), name


def test_lexicon(spark, make_index, as_queries):
    lexicon = spark.createDataFrame([("recipes", "recipe"), ("bananas", "banana")],
                                    "form string, lemma string")
    idx = make_index({1: "banana bananas recipe", 2: "vector"}, lexicon=lexicon)
    assert dict(rows(idx.token, "token", "doc_freq")) == {"banana": 1, "recipe": 1, "vector": 1}
    by_token = idx.term_doc_stats.join(idx.token, "token_id")
    assert dict(rows(by_token, "token", "tf")) == {"banana": 2, "recipe": 1, "vector": 1}
    found = bm25.bm25_topk(idx, as_queries({7: "banana recipes"}))
    assert rows(found, "query_id", "doc_id", "rank") == [(7, 1, 1)]
    assert all(r["violations"] == 0 for r in index.validate_index(idx).collect())


def test_lookup_join_gives_the_same_with_and_without_broadcast(spark):
    # One key holds most rows.
    big = spark.range(2000).select(F.col("id").alias("n"), F.when(F.col("id") < 1500, "hot")
                                   .otherwise(F.col("id").cast("string")).alias("key"))
    small = spark.createDataFrame([("hot", 1), ("1600", 2)], "key string, v int")
    for how in ("inner", "left", "left_semi"):
        a = lookup_join(big, small, "key", how)
        b = lookup_join(big, small, "key", how, limit=0, salts=8)
        assert a.columns == b.columns
        assert sorted(rows(a), key=str) == sorted(rows(b), key=str)


def test_token_dictionary_keeps_known_ids(spark):
    old = spark.createDataFrame([(5, "a")], "token_id long, token string")
    new = spark.createDataFrame([("a",), ("b",), ("b",)], "token string")
    found = {t: i for i, t in rows(lexical.token_dictionary(new, old))}
    assert found["a"] == 5 and set(found) == {"a", "b"}
    assert found["b"] == spark.range(1).select(F.xxhash64(F.lit("b"))).first()[0]


def test_validate_index_reports_each_rule(spark, make_index):
    idx = make_index(TEXTS)
    assert all(r["violations"] == 0 for r in index.validate_index(idx).collect())
    from dataclasses import replace
    bad = replace(
        idx,
        document=idx.document.union(idx.document.filter("doc_id = 1")).withColumn(
            "title", F.lit(None).cast("string")).withColumn(
            "url", F.when(F.col("doc_id") != 2, F.col("url"))),
        token=idx.token.filter("token <> 'bread'"),
        term_doc_stats=idx.term_doc_stats.withColumn("tf", -F.col("tf")))
    links = spark.createDataFrame([(1, 2), (1, 2), (1, 99)], "from_doc_id long, to_doc_id long")
    found = {(r["table_name"], r["rule"]): r["violations"]
             for r in index.validate_index(bad, links).collect()}
    assert found["document", "doc_id unique"] == 1
    assert found["document", "url or title not null"] == 1
    assert found["term_doc_stats", "token_id known"] == 1
    assert found["term_doc_stats", "tf >= 0"] == 7
    assert found["link", "(from_doc_id, to_doc_id) unique"] == 1
    assert found["link", "to_doc_id known"] == 1
    assert found["link", "from_doc_id known"] == 0


def test_a_rebuild_without_positions_leaves_nothing_of_the_old_one(spark, tmp_path):
    def docs(text, key):
        return spark.createDataFrame([(key, text, "u", "t")], "doc_id long, full_text string, "
                                     "url string, title string")
    path = str(tmp_path / "i")
    old = index.write_index(docs("a b", 1), path)
    new = index.write_index(docs("c", 7), path, positions=False)
    assert rows(new.token_position, "doc_id", "position") == [(7, 0)]
    assert sorted(rows(old.token_position, "doc_id", "position")) == [(1, 0), (1, 1)]
    tables = len(spark.catalog.listTables())
    again = index.open_index(spark, path)
    index.open_index(spark, path)
    assert len(spark.catalog.listTables()) == tables
    index.close_index(again)
    assert len(spark.catalog.listTables()) == tables - 2
    assert rows(index.open_index(spark, path).token, "token") == [("c",)]


def test_an_index_is_opened_as_it_was_built(spark, tmp_path):
    docs = spark.createDataFrame([(1, "cats", "u", "t")],
                                 "doc_id long, full_text string, url string, title string")
    lexicon = spark.createDataFrame([("cats", "cat"), ("cats", "cat")], "form string, lemma string")
    path = str(tmp_path / "i")
    assert rows(index.write_index(docs, path, lexicon=lexicon).token, "token") == [("cat",)]
    with pytest.raises(ValueError, match="lexicon"):
        index.open_index(spark, path)
    with pytest.raises(ValueError, match="ascii"):
        index.open_index(spark, path, ascii_words, lexicon)
    two = lexicon.union(spark.createDataFrame([("cats", "dog")], "form string, lemma string"))
    with pytest.raises(Exception, match="two lemmas"):
        lexical.lemmatize(lexical.token_positions(lexical.analyze(docs)), two).collect()


def test_first_pages_of_ties_and_repeats(spark):
    data = [(1, "a", "x"), (1, "a", "y"), (2, "a", "z"), (3, "b", "w"), (3, "b", "w"), (4, None, "v"),
            (4, None, "v"), (None, "c", "n"), (5, "c", "m"), (6, "d", "o")]
    frame = spark.createDataFrame(data, "page_id long, url string, html string")
    picked = [sorted(rows(corpus.first_pages(frame.repartition(n), "page_id"), "url", "html"), key=str)
              for n in (1, 3)]
    assert picked[0] == picked[1] and len(picked[0]) == 6
    assert {("b", "w"), ("c", "n"), ("d", "o"), (None, "v")} < set(picked[0])
    again = corpus.dedupe_url(frame.withColumnRenamed("html", "full_text"), "page_id")
    assert again.filter("url = 'a'").count() == 1


def test_dedupe_url(spark):
    data = [(1, "a", 2), (2, "a", 1), (3, None, 1), (4, None, 2), (5, "b", 9)]
    docs = spark.createDataFrame(data, "doc_id long, url string, arrival int")
    assert sorted(rows(corpus.dedupe_url(docs, "arrival"), "doc_id")) == [(2,), (3,), (4,), (5,)]
    known = spark.createDataFrame([("b",), (None,)], "url string")
    left = corpus.dedupe_url(docs, "arrival", known)
    assert sorted(rows(left, "doc_id")) == [(2,), (3,), (4,)]


def test_dedupe_url_cuts_a_hot_url_before_the_shuffle(spark):
    hot = spark.range(5000).select("id", F.regexp_replace(F.col("id").cast("string"), "\\d+", "same").alias("url"),
                                   F.col("id").alias("arrival"))
    plan = corpus.dedupe_url(hot, "arrival")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "1, Partial" in physical
    assert rows(corpus.dedupe_url(hot, "arrival"), "id") == [(0,)]


def test_ingest_pages_and_rejects(spark):
    pages = spark.createDataFrame(
        [(1, "u1", "<title>T</title><p>x</p>"), (2, "u1", "<p>later</p>"), (3, "u2", None)],
        "page_id long, url string, html string")
    assert rows(corpus.ingest_pages(pages), "url", "title", "full_text") == [("u1", "T", "T x")]
    assert rows(corpus.rejected_pages(pages), "page_id") == [(3,)]
    wide = corpus.ingest_pages(pages, wide_ids=True).first()["doc_id"]
    assert len(wide) == 32


def test_ingest_corpus_and_queries(spark):
    raw = spark.createDataFrame([("d1", "T", "", "body"), ("d2", "", "text", "body")],
                                "doc_id string, title string, text string, body string")
    assert sorted(rows(corpus.ingest_corpus(raw, body="body"))) == [
        ("d1", "T", "T\nbody"), ("d2", None, "text")]
    assert corpus.ingest_corpus(raw, limit=1).count() == 1
    qs = spark.createDataFrame([(1, "", "t"), (2, "x", "t"), (3, None, "")],
                               "query_id long, text string, title string")
    assert sorted(rows(corpus.load_queries(qs, title="title"))) == [(1, "t"), (2, "x")]


def test_load_qrels(spark):
    raw = spark.createDataFrame([(1, 1, 2, 1), (1, 1, 1, 2), (1, 1, 0, 3), (1, 2, 0, 4)],
                                "query_id int, doc_id int, relevance int, seq int")
    assert rows(corpus.load_qrels(raw, "seq")) == [(1, 1, 1)]
    assert rows(corpus.load_qrels(raw)) == [(1, 1, 2)]


def test_link_edges(spark):
    docs = spark.createDataFrame([(1, "http://a/x/p"), (2, "http://a/q"), (3, "http://b/"),
                                  (4, "http://a/x/r")], "doc_id long, url string")
    pages = spark.createDataFrame(
        [("http://a/x/p", ["/q", "r", "http://b/", "//b/", "/missing", "/q"]),
         ("http://nowhere/", ["http://b/"])], "url string, links array<string>")
    assert sorted(rows(lexical.link_edges(pages, docs))) == [(1, 2), (1, 3), (1, 4)]


def test_read_table_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for kind in ("parquet", "json", "orc"):
        df.write.format(kind).save(str(tmp_path / kind))
        assert rows(corpus.read_table(spark, str(tmp_path / kind), kind,
                                      schema=df.schema)) == [(1, "x")]


def test_scratch_dir_needs_a_shared_folder_on_a_cluster(spark):
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

    class Cluster:
        class conf:
            @staticmethod
            def get(*_):
                return None

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        scratch_dir(Cluster, "x")


def test_custom_analyzer(make_index):
    from rankweave.functions.text import ascii_words
    idx = make_index({1: "Été BM25"}, analyzer=ascii_words)
    assert sorted(rows(idx.token, "token")) == [("bm25",), ("t",)]
    assert idx.analyzer is ascii_words and words is not ascii_words


def test_scan_skips_row_groups_without_the_wanted_document(spark, make_index):
    # Even ids only; the odd one lies between the smallest and the largest of every file.
    idx = make_index({i: f"text {i}" for i in range(0, 400, 2)})

    def read_rows(doc_id):
        found = idx.document.filter(F.col("doc_id").isin([doc_id, doc_id + 1000]))
        found.collect()
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        return scan.metrics().get("numOutputRows").get().value()

    assert read_rows(100) > 0
    assert read_rows(101) == 0


def test_written_tables_have_the_documented_types(spark, make_index):
    from rankweave import schemas
    idx = make_index(TEXTS)
    for name in ("document", "token", "term_doc_stats", "token_position", "corpus_stats"):
        expected = {f.name: f.dataType for f in getattr(schemas, name.upper()).fields}
        found = {f.name: f.dataType for f in getattr(idx, name).schema.fields}
        assert found == expected, name
    pages = spark.createDataFrame([("http://a/", ["http://a/"])], "url string, links array<string>")
    docs = spark.createDataFrame([(1, "http://a/")], "doc_id long, url string")
    assert [f.dataType for f in lexical.link_edges(pages, docs).schema] == [
        f.dataType for f in schemas.LINK]
    assert corpus.ingest_pages(spark.createDataFrame([(1, "u", "x")], schemas.PAGE)).count() == 1


def test_postings_are_counted_where_documents_lie(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, "b a b", "u1", "t"), (1, "a", "u2", "t"), (None, "a a", "u3", "t"), (2, None, "u4", "t")],
        "doc_id long, full_text string, url string, title string")
    idx = index.write_index(docs, str(tmp_path / "index"), buckets=3)
    found = idx.term_doc_stats.join(idx.token, "token_id").select("doc_id", "token", "tf", "len")
    # Rows of one id are counted one by one.
    assert sorted(found.collect(), key=str) == sorted(
        [(1, "a", 1, 3), (1, "b", 2, 3), (1, "a", 1, 1), (None, "a", 2, 2)], key=str)
    counted = index._counted(idx.document.sparkSession.table(idx.tables[0]))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "lambda" not in plan


def test_counting_holds_no_table_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_TOKENS", 3)
    schema = "doc_id string, len int, tokens array<string>"
    data = [("a", 4, ["x", "y", "x", "x"]), ("a", 1, ["x"]), (None, 2, ["y", "y"]), ("b", 0, []),
            ("c", 0, None), ("d", 2, [None, "é"])]
    data += [(f"n{i}", 2, ["x", f"w{i}"]) for i in range(50)]
    forward = spark.createDataFrame(data, schema).coalesce(1)
    counted = index._counted(forward)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan
    name = dict(spark.createDataFrame([(t,) for t in ["x", "y", "é", *[f"w{i}" for i in range(50)]]],
                                      "token string")
                .select(lexical.token_id(F.col("token")), "token").collect())
    found = [(r["doc_id"], name[r["token_id"]], r["tf"], r["len"]) for r in counted.collect()]
    expected = [("a", "x", 3, 4), ("a", "y", 1, 4), ("a", "x", 1, 1), (None, "y", 2, 2),
                ("d", "é", 1, 2)]
    expected += [(f"n{i}", t, 1, 2) for i in range(50) for t in ("x", f"w{i}")]
    assert sorted(found, key=str) == sorted(expected, key=str)
    tokens = rows(index._counted_tokens(forward).filter("doc_freq > 1 OR token IS NULL"),
                  "token", "doc_freq")
    assert sorted(tokens, key=str) == [("x", 52), ("y", 2), (None, 1)]


def test_a_build_reads_a_bucket_in_a_task(spark, make_index):
    idx = make_index(TEXTS, buckets=7)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    with pytest.raises(ZeroDivisionError):
        with index.bucket_tasks(spark):
            # Small files would be packed together, large ones cut.
            assert spark.table(idx.tables[0]).select("doc_id", "tokens").rdd.getNumPartitions() == 7
            1 / 0
    assert spark.conf.get(setting) == before


def test_a_build_moves_texts_once(spark, monkeypatch, tmp_path):
    from rankweave.plans import registry
    spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    given = []
    monkeypatch.setattr(index, "write_index", lambda documents, path: given.append(documents))
    monkeypatch.setitem(registry.__dict__, "_built", {})
    registry.built_index(spark, str(tmp_path))
    assert "Exchange" not in given[0]._jdf.queryExecution().executedPlan().toString()


def test_a_bucket_is_small_beside_what_a_task_can_hold():
    assert index.TEXT_PER_BUCKET <= 64_000_000
