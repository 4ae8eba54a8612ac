"""One query per operator over the given tables.

The corpus is `documents` with `doc://<id>` as url and the source as title; the queries are the
texts of `benchmark`. A document that contains a benchmark text word for word is relevant to it:
grade 2 if labelled good, 0 if labelled toxic, else 1. Texts are embedded by the hashing stand-in.
The `embeddings` table has its own key space; where it is joined to documents by number the pairing
is synthetic. Vector queries are the mean vectors of the labels.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import html, scoring, vectors
from ..functions.text import ascii_words, query_instruction, words
from ..operators import (
    bm25, embed, evaluate, fusion, legacy, lexical, product, rerank, vector,
)
from ..session import chunks, lookup_join, materialize, scratch_dir, spread
from ..sources import corpus, index, segments
from ..streaming import ingest
from . import embedding_jobs, evaluation, hybrid

DIMS = 64
RERANK_DIMS = 32
POOL = 100
SHORT_TEXT_BYTES = 64 * 1024
CELLS = 16
SIGN_BITS = 4
PROBES = 14             # of the cells; fewer find less than 0.9 of the nearest
STREAM_FILES = 4
QUERY = "the worthless inesea with hested onstble of the"
SWEEP = [(0.8, 0.3), (1.2, 0.75), (2.0, 0.9)]
REFUSED = "ê"

_built: dict[tuple[str, str], index.LexicalIndex] = {}
_embedded: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as its files lie, for an index build, which deals it to buckets itself."""
    return _as_documents(table(spark, sf_dir, "documents"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_documents(spread(table(spark, sf_dir, "documents"), "doc_id"))


def _as_documents(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", F.col("text").alias("full_text"),
        F.concat(F.lit("doc://"), F.col("doc_id")).alias("url"), F.col("source").alias("title"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.load_queries(table(spark, sf_dir, "benchmark"), "item_id")


def built_index(spark: SparkSession, sf_dir: str) -> index.LexicalIndex:
    """The index of the corpus, built and written once per session and read by all searches."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = index.write_index(stored_documents(spark, sf_dir),
                                        scratch_dir(spark, "index"))
    return _built[key]


def built_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(doc_id, embedding)` of the corpus, embedded and written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _embedded:
        _embedded[key] = materialize(text_vectors(built_index(spark, sf_dir).document), "vectors")
    return _embedded[key]


def containing(document: DataFrame, texts: DataFrame) -> DataFrame:
    """`(query_id, doc_id)` of the documents that contain a text, by one scan for all texts."""
    asked = texts.select("query_id", "text").collect()
    if not asked:
        return document.sparkSession.createDataFrame([], T.StructType(
            [texts.schema["query_id"], document.schema["doc_id"]]))
    wanted = F.array(*[F.struct(F.lit(r["query_id"]).alias("query_id"),
                                F.lit(r["text"]).alias("text")) for r in asked])
    found = F.filter(wanted, lambda x: F.contains(F.col("full_text"), x["text"]))
    return (document.select("doc_id", F.explode(found).alias("x"))
            .select("x.query_id", "doc_id"))


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(query_id, doc_id, relevance)` with grades 0 to 2.

    A document that contains a text has all its inner words, so candidates are found by the rarest
    of them, and only those are compared in full. Texts without inner words are looked for in all
    documents, in parts of bounded size.
    """
    idx, qs = built_index(spark, sf_dir), queries(spark, sf_dir)
    tokens = words(F.col("text"))
    size = F.greatest(F.size(tokens) - 2, F.lit(0))
    inner = qs.select("query_id", F.explode(F.slice(tokens, F.lit(2), size)).alias("token"))
    rarest = (inner.join(idx.token, "token").groupBy("query_id")
              .agg(F.min_by("token_id", F.struct("doc_freq", "token")).alias("token_id")))
    candidates = materialize(lookup_join(idx.term_doc_stats, rarest, "token_id")
                             .select("query_id", "doc_id"))
    pairs = (rerank.fetch_documents(candidates, idx.document).join(qs, "query_id")
             .filter(F.contains("full_text", "text")).select("query_id", "doc_id"))
    short = qs.filter(F.size(tokens) <= 2)
    for part in chunks(short, "query_id", SHORT_TEXT_BYTES):
        pairs = pairs.unionByName(containing(idx.document, part))
    grade = (F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1))
    return (pairs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
            .select("query_id", "doc_id", grade.alias("relevance")))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(corpus.load_qrels(judgments(spark, sf_dir)))


def text_vectors(rows: DataFrame, dims: int = DIMS) -> DataFrame:
    return embed.embed_documents(rows.select("doc_id", "full_text"),
                                 embed.hashing_embedder(dims), dims=dims).select(
        "doc_id", "embedding")


def query_vectors(qs: DataFrame, dims: int = DIMS) -> DataFrame:
    return hybrid.embed_queries(qs, embed.hashing_embedder(dims), dims)


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector per label. Values are averaged per place, so a frequent label is combined in
    the map tasks."""
    rows = table(spark, sf_dir, "embeddings").select(
        "label", F.posexplode("embedding").alias("place", "value"))
    means = rows.groupBy("label", "place").agg(F.avg(F.col("value").cast("double")).alias("value"))
    # One row per label and place is left: a label's list is as long as a vector is wide.
    return materialize(
        means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("place", "value")))
                                   .alias("places"))
        .select(F.col("label").cast("long").alias("query_id"),
                F.col("places.value").alias("embedding")))


def numbered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def partly_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the vector of the same number, null where there is none."""
    return documents(spark, sf_dir).join(numbered_vectors(spark, sf_dir), "doc_id", "left")


def places(df: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """One row per vector value."""
    return df.select(F.col(key), F.posexplode(column).alias("place", "value")).select(
        key, "place", scoring.rounded(F.col("value").cast("double"), 9).alias("value"))


def overlap(query: Column, text: Column) -> Column:
    """Share of the distinct query words that the text has."""
    asked = F.array_distinct(words(query))
    return (F.size(F.array_intersect(asked, words(text))).cast("double")
            / F.greatest(F.size(asked), F.lit(1)))


def length_logits(prompts: list[str]) -> list[list[float]]:
    """A stand-in for a judging model: looks at the length of the prompt only."""
    return [[0.0, (len(prompt) % 101) / 50 - 1] for prompt in prompts]


def bm25_run(spark: SparkSession, sf_dir: str, depth: int = POOL, **params) -> DataFrame:
    return bm25.bm25_topk(built_index(spark, sf_dir), queries(spark, sf_dir), top_k=depth,
                          **params)


def lexical_retriever(spark: SparkSession, sf_dir: str, depth: int = POOL) -> hybrid.Retriever:
    return hybrid.bm25_retriever(built_index(spark, sf_dir), top_k=depth)


def nearest_retriever(spark: SparkSession, sf_dir: str, depth: int = POOL) -> hybrid.Retriever:
    document = built_index(spark, sf_dir).document
    return hybrid.vector_retriever(built_vectors(spark, sf_dir), embed.hashing_embedder(DIMS),
                                   document, depth, DIMS)


def cosine_ranker(spark: SparkSession, sf_dir: str, top_n: int | None) -> hybrid.Ranker:
    """Compares candidates with vectors of another width; only candidates are embedded."""
    document = built_index(spark, sf_dir).document

    def ranker(qs: DataFrame, candidates: DataFrame) -> DataFrame:
        texts = rerank.fetch_documents(candidates.select("doc_id").distinct(), document)
        return rerank.rerank_cosine(candidates, query_vectors(qs, RERANK_DIMS),
                                    text_vectors(texts, RERANK_DIMS), top_n)
    return ranker


def overlap_ranker(spark: SparkSession, sf_dir: str, top_n: int | None) -> hybrid.Ranker:
    document = built_index(spark, sf_dir).document
    return lambda qs, candidates: rerank.rerank(qs, candidates, document, overlap, top_n)


# ---- the queries ---------------------------------------------------------------------------


def q_ingest_corpus(spark, d):
    return corpus.ingest_corpus(table(spark, d, "documents"), title="source")


def pages(spark, d):
    return spread(table(spark, d, "pages"), "page_id")


def q_ingest_pages(spark, d):
    return corpus.ingest_pages(pages(spark, d)).select("url", "title", "full_text")


def q_html_text(spark, d):
    return pages(spark, d).select("page_id", html.html_text(F.col("html")).alias("text"))


def q_html_title(spark, d):
    return pages(spark, d).select("page_id", html.html_title(F.col("html")).alias("title"))


def conversation_rows(spark, d):
    """Turns as documents; those of one conversation share a url, system turns have none."""
    return table(spark, d, "conversations").select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("doc_id"),
        F.col("text").alias("full_text"),
        F.when(F.col("role") != "system", F.concat(F.lit("conv://"), F.col("conv_id")))
        .alias("url"),
        F.lit(None).cast("string").alias("title"), F.col("turn").alias("arrival"))


def q_dedupe_url(spark, d):
    return corpus.dedupe_url(conversation_rows(spark, d), "arrival").select("doc_id", "url")


def q_write_index(spark, d):
    path = scratch_dir(spark, "index")
    index.write_index(stored_documents(spark, d), path)
    idx = index.open_index(spark, path)
    return (idx.term_doc_stats.join(idx.token, "token_id")
            .select("doc_id", "token", "tf", "len", "doc_freq"))


def q_add_documents(spark, d):
    """The documents in four arrivals, each a segment, two and two of a size merged."""
    path = scratch_dir(spark, "index")
    docs = stored_documents(spark, d)
    buckets = index.buckets_for(docs)
    docs = docs.withColumn("_arrival", F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    arrivals = [docs.filter(F.col("_arrival") == i).drop("_arrival") for i in range(4)]
    index.write_index(arrivals[0], path, buckets=buckets)
    for arrived in arrivals[1:]:
        segments.add_documents(arrived, path, fanout=2, keep_dead=False)
    return index.named_postings(index.open_index(spark, path)).select(
        "doc_id", "token", "tf", "len", "doc_freq")


def q_validate_index(spark, d):
    rows = conversation_rows(spark, d).drop("arrival")
    return index.validate_index(index.write_index(rows, scratch_dir(spark, "index")))


def q_load_queries(spark, d):
    return queries(spark, d)


def q_load_qrels(spark, d):
    return qrels(spark, d)


def q_link_edges(spark, d):
    links = corpus.page_links(pages(spark, d))
    site = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    targets = (links.select("url", F.explode("links").alias("href"))
               .select(F.concat(site, "href").alias("url")))
    known = links.select("url").union(targets).distinct()
    docs = known.select(corpus.url_doc_id(F.col("url"), F.col("url"), wide=True).alias("doc_id"),
                        "url")
    return lexical.link_edges(links, docs)


def q_tokenize_words(spark, d):
    tokens = words(F.col("full_text"))
    return documents(spark, d).select(
        "doc_id", F.concat_ws(" ", tokens).alias("tokens"))


def q_tokenize_ascii(spark, d):
    tokens = ascii_words(F.col("full_text"))
    return documents(spark, d).select(
        "doc_id", F.concat_ws(" ", tokens).alias("tokens"))


def q_lemmatize_vocab(spark, d):
    """Plurals by the rules for English nouns, where the corpus has the singular too."""
    positions = lexical.token_positions(lexical.analyze(documents(spark, d)))
    lexicon = materialize(lexical.noun_lexicon(built_index(spark, d).token), "lexicon")
    return lexical.lemmatize(positions, lexicon).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"))


def q_token_positions(spark, d):
    return lexical.token_positions(lexical.analyze(documents(spark, d))).select(
        "doc_id", "position", "token")


def q_term_frequency(spark, d):
    return lexical.term_frequency(lexical.analyze(documents(spark, d))).select(
        "doc_id", "token", "tf")


def q_doc_length(spark, d):
    return lexical.doc_length(lexical.analyze(documents(spark, d)))


def q_doc_frequency(spark, d):
    postings = lexical.term_frequency(lexical.analyze(documents(spark, d)))
    return lexical.doc_frequency(postings)


def q_token_dictionary(spark, d):
    """The dictionary of the corpus, extended by the words of the benchmark."""
    old = built_index(spark, d).token
    new = bm25.query_terms(queries(spark, d), words)
    return lexical.token_dictionary(new, old).groupBy("token").agg(
        F.countDistinct("token_id").alias("ids"))


def q_corpus_stats(spark, d):
    stats = lexical.corpus_stats(lexical.analyze(documents(spark, d)))
    return stats.select("total_docs", "total_len", scoring.rounded(F.col("avgdl"), 9)
                        .alias("avgdl"))


def q_idf_table(spark, d):
    idx = built_index(spark, d)
    return lexical.idf_table(idx.token, idx.corpus_stats).select(
        "token", "doc_freq", scoring.rounded(F.col("idf"), 9).alias("idf"))


def q_bm25_topk(spark, d):
    query = spark.createDataFrame([(0, QUERY)], "query_id long, text string")
    idx = built_index(spark, d)
    return bm25.attach_titles(bm25.bm25_topk(idx, query), idx.document)


def q_bm25_batch(spark, d):
    return bm25_run(spark, d, 1000)


def q_bm25_pruned(spark, d):
    """The ten best of each query, without scoring documents that cannot be among them."""
    return bm25.bm25_topk(built_index(spark, d), queries(spark, d), top_k=10, prune=True)


def q_bm25_rank_all(spark, d):
    return bm25.bm25_rank_all(built_index(spark, d), queries(spark, d), top_k=1000)


def q_bm25_explain(spark, d):
    top = bm25_run(spark, d, 1)
    return bm25.bm25_explain(built_index(spark, d), queries(spark, d), top)


def q_bm25_sweep(spark, d):
    return bm25.bm25_sweep(built_index(spark, d), queries(spark, d), SWEEP)


def q_vector_topk(spark, d):
    return vector.vector_topk(numbered_vectors(spark, d), label_means(spark, d), POOL)


def searched_cells(spark, d, k, nprobe):
    docs = numbered_vectors(spark, d)
    centers = vector.train_cells(docs, CELLS)
    cells = vector.write_cells(vector.assign_cells(docs, centers), scratch_dir(spark, "cells"))
    return vector.vector_ann(cells, centers, label_means(spark, d), k, nprobe)


def q_vector_ann(spark, d):
    """Cells by sign bits, which SQL can state too."""
    docs = numbered_vectors(spark, d)
    centers = vector.sign_cells(DIMS, SIGN_BITS)
    cells = vector.write_cells(vector.assign_cells(docs, centers), scratch_dir(spark, "cells"))
    return vector.vector_ann(cells, centers, label_means(spark, d), POOL, PROBES)


def q_vector_product(spark, d):
    """Codes of a sixteenth of the bytes, and short lists of twice the wanted size scored exactly."""
    docs = numbered_vectors(spark, d)
    found = product.write_product_index(docs, scratch_dir(spark, "product"),
                                        vector.train_cells(docs, CELLS))
    return product.product_search(found, label_means(spark, d), POOL, short=2)


def q_vector_ann_all_cells(spark, d):
    """With every cell probed the approximate search is exact."""
    return searched_cells(spark, d, POOL, CELLS)


def q_query_instruction(spark, d):
    return queries(spark, d).select("query_id", query_instruction(F.col("text")).alias("text"))


def q_rrf(spark, d):
    idx, qs = built_index(spark, d), queries(spark, d)
    lists = [hybrid.bm25_retriever(idx, k1, b, POOL)(qs) for k1, b in ((1.5, 0.75), (0.8, 0.3))]
    return fusion.reciprocal_rank_fusion(lists)


def q_hybrid_search(spark, d):
    engine = hybrid.HybridSearch([lexical_retriever(spark, d, 10), nearest_retriever(spark, d, 10)],
                                [cosine_ranker(spark, d, 20)])
    return engine.search(queries(spark, d))


def matched(spark, d):
    return legacy.matched_tokens(built_index(spark, d), queries(spark, d))


def rounded_score(df: DataFrame) -> DataFrame:
    return df.select("query_id", "doc_id",
                     scoring.rounded(F.col("score"), scoring.BM25_DIGITS).alias("score"))


def q_legacy_match(spark, d):
    return legacy.legacy_match(matched(spark, d))


def q_legacy_frequency(spark, d):
    return rounded_score(legacy.legacy_frequency(matched(spark, d)))


def q_legacy_position(spark, d):
    scores = legacy.legacy_position(matched(spark, d))
    return scores.select("query_id", "doc_id", "times",
                         scoring.rounded(F.col("score"), scoring.BM25_DIGITS).alias("score"))


def q_legacy_normalize(spark, d):
    """BM25 scores scaled both ways."""
    run = materialize(bm25_run(spark, d))
    high = legacy.legacy_normalize(run.select("query_id", "doc_id", "score"))
    low = legacy.legacy_normalize(run.select("query_id", "doc_id", "score"), True)
    return high.select("query_id", "doc_id", scoring.rounded(F.col("score"), 9).alias("high")).join(
        low.select("query_id", "doc_id", scoring.rounded(F.col("score"), 9).alias("low")),
        ["query_id", "doc_id"])


def q_legacy_rank(spark, d):
    return legacy.legacy_rank(matched(spark, d))


def q_rerank(spark, d):
    qs = queries(spark, d)
    return hybrid.rerank_chain(qs, lexical_retriever(spark, d)(qs), [overlap_ranker(spark, d, 20)])


def q_rerank_cosine(spark, d):
    qs = queries(spark, d)
    return hybrid.rerank_chain(qs, lexical_retriever(spark, d)(qs), [cosine_ranker(spark, d, 20)])


def yes_ranker(spark, d, top_n):
    document = built_index(spark, d).document
    return lambda qs, candidates: rerank.rerank_yes_prob(
        qs, candidates, document, rerank.logits_column(length_logits), top_n)


def q_rerank_yes_prob(spark, d):
    qs = queries(spark, d)
    return hybrid.rerank_chain(qs, lexical_retriever(spark, d)(qs), [yes_ranker(spark, d, 20)])


def q_rerank_chain(spark, d):
    qs = queries(spark, d)
    return hybrid.rerank_chain(qs, lexical_retriever(spark, d)(qs),
                               [overlap_ranker(spark, d, 20), yes_ranker(spark, d, 10)])


def q_l2_normalize(spark, d):
    rows = table(spark, d, "embeddings").select(
        "vec_id", vectors.l2_normalize(F.col("embedding")).alias("embedding"))
    return places(rows, "vec_id")


def q_truncate_dims(spark, d):
    rows = table(spark, d, "embeddings").select(
        "vec_id", vectors.truncate_dims(F.col("embedding"), 16).alias("embedding"))
    return places(rows, "vec_id")


def q_embed_documents(spark, d):
    return places(text_vectors(documents(spark, d)), "doc_id")


def refusing_embedder(refused: str, dims: int) -> embed.EmbedFunction:
    inner = embed.hashing_embedder(dims)

    def run(texts: list[str]):
        if any(refused in text for text in texts):
            raise ValueError("refused")
        return inner(texts)
    return run


def q_embed_batch_policy(spark, d):
    policy = embed.EmbedPolicy(batch_size=64, max_tries=1, delay=0.0)
    rows = embed.embed_documents(documents(spark, d), refusing_embedder(REFUSED, DIMS), dims=DIMS,
                                 policy=policy)
    return rows.select("doc_id", "embed_error", F.size("embedding").alias("width"))


def q_backfill_embeddings(spark, d):
    path = scratch_dir(spark, "backfill")
    partly_embedded(spark, d).write.parquet(f"{path}/documents")
    filled = embedding_jobs.backfill_files(spark, f"{path}/documents", f"{path}/filled",
                                           embed.hashing_embedder(DIMS), "hashing", DIMS,
                                           files_per_step=4)
    return places(filled, "doc_id")


def q_reembed_documents(spark, d):
    done = embedding_jobs.reembed_documents(
        spark, f"{d}/documents.parquet", scratch_dir(spark, "reembed"),
        embed.hashing_embedder(DIMS), "hashing", DIMS, confirm=True, text="text")
    return places(done, "doc_id")


def q_embedding_audit(spark, d):
    return embed.embedding_audit(partly_embedded(spark, d))


def q_build_run(spark, d):
    return evaluate.build_run(bm25_run(spark, d), "bm25", built_index(spark, d).document)


def one_metric(metric: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, d):
        run = materialize(evaluate.build_run(bm25_run(spark, d), "bm25"))
        rows = evaluate.query_metrics(run, qrels(spark, d), (metric,), missing="zero")
        return rows.select("mode", "query_id",
                           scoring.rounded(F.col(f"`{metric}`"), 9).alias(name))
    return query


def q_evaluate_run(spark, d):
    run = materialize(evaluate.build_run(bm25_run(spark, d, 1000), "bm25"))
    return evaluate.evaluate_run(run, qrels(spark, d))


def four_modes(spark, d):
    run = evaluation.compare_modes(queries(spark, d), lexical_retriever(spark, d),
                                   nearest_retriever(spark, d), cosine_ranker(spark, d, POOL),
                                   pool=POOL)
    return evaluate.evaluate_run(run, qrels(spark, d))


def q_compare_modes(spark, d):
    return evaluate.compare(four_modes(spark, d), list(evaluation.MODES))


def q_best_mode(spark, d):
    return evaluate.best_mode(four_modes(spark, d), list(evaluation.MODES))


def q_latency_summary(spark, d):
    """The values of the events stand in for measured seconds, their type for the mode."""
    return evaluate.latency_summary(table(spark, d, "events").select(
        F.col("event_type").alias("mode"), F.col("value").alias("seconds")))


def q_eval_resume(spark, d):
    idx, path = built_index(spark, d), scratch_dir(spark, "runs")
    config = {"k1": 1.5, "b": 0.75, "top_k": POOL}
    return evaluation.resume_run(queries(spark, d),
                                 lambda qs: bm25.bm25_topk(idx, qs, 1.5, 0.75, POOL),
                                 path, config, slices=2)


def resumed_modes(spark, d):
    return evaluation.resume_modes(
        queries(spark, d), lexical_retriever(spark, d), nearest_retriever(spark, d),
        cosine_ranker(spark, d, POOL), scratch_dir(spark, "modes"), {"dims": DIMS}, POOL, slices=2)


def q_eval_resume_modes(spark, d):
    """All four modes in slices that can be resumed, and what they score."""
    return evaluate.evaluate_run(materialize(resumed_modes(spark, d)[0]), qrels(spark, d))


def q_eval_latency(spark, d):
    """The seconds measured with the modes."""
    return evaluate.latency_summary(resumed_modes(spark, d)[1])


def page_arrivals(spark, d):
    """Pages in the order they arrive: those of the table, then even turns of the conversations,
    then odd ones. Turns of a conversation share a url, system turns have none."""
    turns = table(spark, d, "conversations")
    url = F.when(F.col("role") != "system", F.concat(F.lit("conv://"), F.col("conv_id")))
    found = [table(spark, d, "pages").select("page_id", "url", "html")]
    for odd in (0, 1):
        found.append(turns.filter(F.col("turn") % 2 == odd).select(
            ((odd + 1) * 10 ** 12 + F.col("conv_id") * 100000 + F.col("turn")).alias("page_id"),
            url.alias("url"), F.col("text").alias("html")))
    return found


def arriving(spark, d, path):
    """A stream of the pages in several batches."""
    for pages_ in page_arrivals(spark, d):
        # A url lies in one file, so how files fall into batches does not matter.
        pages_.repartition(STREAM_FILES, F.coalesce("url", F.col("page_id").cast("string"))) \
            .write.mode("append").parquet(f"{path}/in")
    return (spark.readStream.schema("page_id bigint, url string, html string")
            .option("maxFilesPerTrigger", STREAM_FILES).parquet(f"{path}/in"))


def streamed(idx):
    return (idx.term_doc_stats.join(idx.token, "token_id")
            .join(idx.document.select("doc_id", "url", "title"), "doc_id")
            .select("url", "title", "len", "token", "tf", "doc_freq"))


def q_stream_ingest(spark, d):
    """Several batches; a url seen in an earlier one is not taken again."""
    path = scratch_dir(spark, "stream")
    ingest.stream_ingest(arriving(spark, d, path), f"{path}/index",
                         f"{path}/checkpoint").awaitTermination()
    return streamed(ingest.read_stream_index(spark, f"{path}/index"))


def q_stream_segments(spark, d):
    """The same pages as segments of a bucketed index."""
    path = scratch_dir(spark, "stream")
    ingest.stream_segments(arriving(spark, d, path), f"{path}/index", f"{path}/checkpoint",
                           buckets=spark.sparkContext.defaultParallelism).awaitTermination()
    return streamed(index.open_index(spark, f"{path}/index"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name[2:]: fn for name, fn in globals().items()
             if re.match(r"q_[a-z]", name) and callable(fn)}
    found |= {
        "precision_at_k": one_metric("precision@10", "precision_at_10"),
        "recall_at_k": one_metric("recall@100", "recall_at_100"),
        "mrr_at_k": one_metric("mrr@10", "mrr_at_10"),
        "average_precision": one_metric("map", "average_precision"),
        "ndcg_at_k": one_metric("ndcg@10", "ndcg_at_10"),
    }
    return found
