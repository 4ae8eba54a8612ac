"""The queries of the registry as SQL over the same tables."""

from __future__ import annotations

from ..functions.html import BLOCKS
from ..functions.text import QUERY_TASK
from ..operators.lexical import LEAST_STEM, NO_PLURAL, NOUN_ENDINGS, NOUN_EXCEPTIONS
from .registry import DIMS, POOL, PROBES, QUERY, REFUSED, RERANK_DIMS, SIGN_BITS, SWEEP

WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
ASCII = r"regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"


def words(column: str) -> str:
    return WORDS.format(column)


def with_(parts: list[str], select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


DOCS = f"""docs AS (
  SELECT doc_id, text AS full_text, 'doc://' || doc_id AS url, source AS title,
         {words('text')} AS tokens FROM documents)"""
POSITIONS = """pos AS (
  SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS position
  FROM docs)"""
POSTINGS = """post AS (
  SELECT p.doc_id, p.token, count(*) AS tf, any_value(len(d.tokens)) AS len
  FROM pos p JOIN docs d USING (doc_id) GROUP BY p.doc_id, p.token)"""
DF = "df AS (SELECT token, count(*) AS doc_freq FROM post GROUP BY token)"
STATS = """stats AS (
  SELECT count(*)::DOUBLE AS n, avg(len(tokens)) AS avgdl FROM docs)"""
QUERIES = "q AS (SELECT item_id AS query_id, text FROM benchmark WHERE text <> '')"
QUERY_TOKENS = f"""qpos AS (
  SELECT query_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS position
  FROM (SELECT query_id, {words('text')} AS t FROM q))"""
SET_TERMS = "terms AS (SELECT DISTINCT query_id, token, 1 AS weight FROM qpos)"
BAG_TERMS = "terms AS (SELECT query_id, token, count(*) AS weight FROM qpos GROUP BY ALL)"
CORPUS = [DOCS, POSITIONS, POSTINGS, DF, STATS]
SEARCH = [*CORPUS, QUERIES, QUERY_TOKENS, SET_TERMS]


def weight_sql(k1: str = "1.5e0", b: str = "0.75e0") -> str:
    return (f"ln(1e0 + (stats.n - df.doc_freq + 0.5e0) / (df.doc_freq + 0.5e0))"
            f" * (post.tf * ({k1} + 1e0))"
            f" / (post.tf + {k1} * (1e0 - {b} + {b} * post.len / stats.avgdl))")


def bm25(name: str, k: int | None, k1: str = "1.5e0", b: str = "0.75e0") -> list[str]:
    """CTE `name` with the best `k` documents per query."""
    cut = "" if k is None else f" WHERE rank <= {k}"
    return [f"""{name}_scores AS (
  SELECT terms.query_id, post.doc_id,
         round(sum(terms.weight * {weight_sql(k1, b)}), 9) AS score
  FROM post JOIN terms USING (token) JOIN df USING (token) CROSS JOIN stats
  GROUP BY terms.query_id, post.doc_id)""",
            f"""{name} AS (
  SELECT * FROM (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER
      AS rank FROM {name}_scores){cut})"""]


def hashed(name: str, source: str, key: str, column: str, dims: int) -> list[str]:
    """CTE `name(key, place, value)`: the unit vector of the hashing stand-in, whole."""
    return [f"""{name}_sums AS (
  SELECT {key}, ('0x' || substr(md5(token), 1, 8))::BIGINT % {dims} AS place,
         sum(CASE WHEN substr(md5(token), 9, 1) >= '8' THEN -1 ELSE 1 END)::DOUBLE AS value
  FROM (SELECT {key}, unnest({words(column)}) AS token FROM {source}) GROUP BY 1, 2)""",
            f"""{name} AS (
  SELECT k.{key}, p.place::INTEGER AS place,
         CASE WHEN n.norm > 0 THEN (coalesce(s.value, 0) / n.norm)::FLOAT::DOUBLE ELSE 0 END
           AS value
  FROM {source} k CROSS JOIN range({dims}) p(place)
  LEFT JOIN {name}_sums s ON s.{key} = k.{key} AND s.place = p.place
  LEFT JOIN (SELECT {key}, sqrt(sum(value * value)) AS norm FROM {name}_sums GROUP BY 1) n
    ON n.{key} = k.{key})"""]


def instructed(name: str, dims: int) -> list[str]:
    source = f"""{name}_text AS (
  SELECT query_id, 'Instruct: {QUERY_TASK}' || chr(10) || 'Query: ' || text AS text FROM q)"""
    return [source, *hashed(name, f"{name}_text", "query_id", "text", dims)]


def cosines(name: str, doc: str, query: str) -> str:
    return f"""{name} AS (
  SELECT query_id, doc_id, round(dot / (dn * qn), 6) AS score FROM (
    SELECT v.query_id, d.doc_id, sum(d.value * v.value) AS dot
    FROM {doc} d JOIN {query} v USING (place) GROUP BY 1, 2)
  JOIN (SELECT doc_id, sqrt(sum(value * value)) AS dn FROM {doc} GROUP BY 1) USING (doc_id)
  JOIN (SELECT query_id, sqrt(sum(value * value)) AS qn FROM {query} GROUP BY 1) USING (query_id)
  WHERE dn > 0 AND qn > 0)"""


def nearest(name: str, k: int) -> list[str]:
    """CTE `name`: the best documents by the vectors of the hashing stand-in."""
    return [*hashed("dv", "docs", "doc_id", "full_text", DIMS), *instructed("qv", DIMS),
            cosines(f"{name}_scores", "dv", "qv"), f"""{name} AS (
  SELECT * FROM (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER
      AS rank FROM {name}_scores) WHERE rank <= {k})"""]


def fused(name: str, lists: list[str]) -> list[str]:
    stacked = " UNION ALL ".join(
        f"SELECT {i} AS list_idx, query_id, doc_id, rank FROM {t}" for i, t in enumerate(lists))
    return [f"{name}_all AS ({stacked})", f"""{name} AS (
  SELECT query_id, doc_id, score,
         (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first))::INTEGER AS rank
  FROM (SELECT query_id, doc_id, round(sum(1e0 / (60 + rank)), 12) AS score,
               min(list_idx * 1000000 + rank) AS first
        FROM {name}_all GROUP BY 1, 2))"""]


def reranked(name: str, source: str, score: str, k: int, joins: str = "") -> str:
    """CTE `name`: the rows of `source` with a new score; old ranks settle ties."""
    return f"""{name} AS (
  SELECT query_id, doc_id, score, rank FROM (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prior))::INTEGER
      AS rank
    FROM (SELECT c.query_id, c.doc_id, c.rank AS prior, {score} AS score
          FROM {source} c JOIN docs d USING (doc_id) JOIN q USING (query_id) {joins}))
  WHERE rank <= {k})"""


OVERLAP = (f"round(len(list_intersect(list_distinct({words('q.text')}), d.tokens))::DOUBLE"
           f" / greatest(len(list_distinct({words('q.text')})), 1), 6)")
PROMPT = (f"'<Instruct>: {QUERY_TASK}'"
          " || chr(10) || '<Query>: ' || q.text || chr(10) || '<Document>: ' || d.full_text")
YES = f"round(1e0 / (1e0 + exp(0e0 - ((length({PROMPT}) % 101) / 50e0 - 1e0))), 6)"
TITLED = "SELECT r.query_id, r.doc_id, d.title AS doc_title, r.score, r.rank FROM {} r JOIN docs d USING (doc_id)"

RERANK_VECTORS = [*hashed("rd", "docs", "doc_id", "full_text", RERANK_DIMS),
                  *instructed("rq", RERANK_DIMS), cosines("rcos", "rd", "rq")]
RCOS_JOIN = "LEFT JOIN rcos USING (doc_id, query_id)"
RCOS = "coalesce(rcos.score, 0e0)"

JUDGED = """judged AS (
  SELECT b.item_id AS query_id, d.doc_id,
         CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 2 ELSE 1 END AS relevance
  FROM documents d JOIN benchmark b ON contains(d.text, b.text)
  LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
QRELS = """qrels AS (
  SELECT query_id, doc_id, max(relevance)::INTEGER AS relevance FROM judged
  WHERE relevance > 0 GROUP BY 1, 2)"""


def metrics(run: str, missing: str) -> list[str]:
    """CTE `per_query(mode, query_id, ...)` with all five metrics of `run`."""
    judged = ("SELECT DISTINCT r.mode, r.query_id FROM {0} r WHERE query_id IN "
              "(SELECT query_id FROM qrels)" if missing == "drop" else
              "SELECT m.mode, j.query_id FROM (SELECT DISTINCT mode FROM {0}) m "
              "CROSS JOIN (SELECT DISTINCT query_id FROM qrels) j").format(run)
    return [f"pairs AS ({judged})", f"""hits AS (
  SELECT r.mode, r.query_id, r.rank, l.relevance,
         row_number() OVER (PARTITION BY r.mode, r.query_id ORDER BY r.rank) AS hit
  FROM {run} r JOIN qrels l USING (query_id, doc_id))""", """gains AS (
  SELECT query_id, count(*) AS relevant,
         sum(CASE WHEN pos <= 10 THEN relevance / log2(pos + 1) ELSE 0 END) AS ideal
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS pos
        FROM qrels) GROUP BY 1)""", """per_query AS (
  SELECT p.mode, p.query_id,
         count(*) FILTER (h.rank <= 10) / 10e0 AS precision_at_10,
         count(*) FILTER (h.rank <= 100) / any_value(g.relevant)::DOUBLE AS recall_at_100,
         coalesce(1e0 / min(h.rank) FILTER (h.rank <= 10), 0e0) AS mrr_at_10,
         coalesce(sum(h.hit / h.rank::DOUBLE), 0e0) / any_value(g.relevant) AS average_precision,
         coalesce(sum(h.relevance / log2(h.rank + 1)) FILTER (h.rank <= 10), 0e0)
           / any_value(g.ideal) AS ndcg_at_10
  FROM pairs p JOIN gains g USING (query_id) LEFT JOIN hits h USING (mode, query_id)
  GROUP BY 1, 2)"""]


EVALUATED = """evaluated AS (
  UNPIVOT (
    SELECT mode, count(*) AS scored_queries, round(avg(ndcg_at_10), 9) AS "ndcg@10",
           round(avg(recall_at_100), 9) AS "recall@100", round(avg(average_precision), 9) AS "map",
           round(avg(mrr_at_10), 9) AS "mrr@10", round(avg(precision_at_10), 9) AS "precision@10"
    FROM per_query GROUP BY mode)
  ON "ndcg@10", "recall@100", "map", "mrr@10", "precision@10" INTO NAME metric VALUE score)"""

BM25_RUN = [*SEARCH, *bm25("best", POOL), "run AS (SELECT 'bm25' AS mode, * FROM best)"]
ALL_MODES = [*SEARCH, *bm25("best", POOL), *nearest("near", POOL), *fused("rrf", ["best", "near"]),
             *RERANK_VECTORS, f"pool AS (SELECT * FROM rrf WHERE rank <= {POOL})",
             reranked("chosen", "pool", RCOS, POOL, RCOS_JOIN), """run AS (
  SELECT 'bm25' AS mode, query_id, doc_id, rank FROM best
  UNION ALL SELECT 'vector', query_id, doc_id, rank FROM near
  UNION ALL SELECT 'rrf', query_id, doc_id, rank FROM rrf
  UNION ALL SELECT 'reranked', query_id, doc_id, rank FROM chosen)""",
             JUDGED, QRELS, *metrics("run", "drop"), EVALUATED]


def one_metric(name: str) -> str:
    return with_([*BM25_RUN, JUDGED, QRELS, *metrics("run", "zero")],
                 f"SELECT mode, query_id, round({name}, 9) AS {name} FROM per_query")


MATCHED = [DOCS, POSITIONS, QUERIES, QUERY_TOKENS, SET_TERMS, """matched AS (
  SELECT terms.query_id, pos.doc_id, pos.token, count(*) AS locations, min(pos.position) AS first
  FROM pos JOIN terms USING (token) GROUP BY 1, 2, 3)""", """sums AS (
  SELECT query_id, doc_id, count(*) AS times, sum(locations)::DOUBLE AS frequency,
         sum(first)::DOUBLE AS position FROM matched GROUP BY 1, 2)""", """scaled AS (
  SELECT query_id, doc_id, times,
         (frequency + 1e-5) / (max(frequency) OVER (PARTITION BY query_id) + 1e-5) AS frequency,
         min(position) OVER (PARTITION BY query_id) / (position + 1e-5) AS position
  FROM sums)"""]


ATTRS = r"""(?:[\s/](?:[^>=]|=\s*"[^"]*"|=\s*''[^'']*''|=)*)?"""


def page_text(column: str) -> str:
    """The chain of replacements that leaves the visible text."""
    text = column
    for pattern, gap in (
            (r"<script\b[^>]*>.*?</script\s*>", ""), (r"<style\b[^>]*>.*?</style\s*>", ""),
            (r"<template\b[^>]*>.*?</template\s*>", ""), ("<!--.*?-->", ""), ("<[!?][^>]*>", ""),
            (f"</?(?:{'|'.join(BLOCKS)}){ATTRS}>", " "), (rf"</?[A-Za-z][^\s/>]*{ATTRS}>", ""),
            (r"</?[A-Za-z][^>]*>", "")):
        text = f"regexp_replace({text}, '{pattern}', '{gap}', 'gis')"
    text = entities(text)
    text = rf"regexp_replace({text}, '[\s\x{{00a0}}]+', ' ', 'g')"
    return f"trim({text}, ' ')"


def entities(text: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                         ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return text


PAGE_TITLE = (r"nullif(regexp_replace("
              + entities(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
              + r", '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g'), '')")

TURNS = """turns AS (
  SELECT conv_id * 100000 + turn AS doc_id, text AS full_text, turn,
         CASE WHEN role <> 'system' THEN 'conv://' || conv_id END AS url FROM conversations)"""

LABEL_MEANS = """means AS (
  SELECT label::BIGINT AS query_id, place, avg(value::DOUBLE) AS value
  FROM (SELECT label, unnest(embedding) AS value, generate_subscripts(embedding, 1) AS place
        FROM embeddings) GROUP BY 1, 2)"""
FLAT = """flat AS (
  SELECT vec_id AS doc_id, unnest(embedding)::DOUBLE AS value,
         generate_subscripts(embedding, 1) AS place FROM embeddings)"""


def unit_places(dims: int) -> str:
    return f"""SELECT vec_id, (place - 1)::INTEGER AS place,
  round(CASE WHEN norm > 0 THEN value / norm ELSE value END, 9) AS value
FROM (SELECT doc_id AS vec_id, place, value,
             sqrt(sum(value * value) OVER (PARTITION BY doc_id)) AS norm
      FROM flat WHERE place <= {dims})"""


def all_sql() -> dict[str, str]:
    embedded = with_([DOCS, *hashed("dv", "docs", "doc_id", "full_text", DIMS)],
                     "SELECT doc_id, place, round(value, 9) AS value FROM dv")
    exact_neighbours = with_([LABEL_MEANS, FLAT, cosines("near", "flat", "means")], f"""
SELECT * FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank
  FROM near) WHERE rank <= {POOL}""")
    probed_neighbours = with_([LABEL_MEANS, FLAT, cosines("near", "flat", "means"), f"""dirs AS (
  SELECT j, place, CASE WHEN substr(md5(j || ':' || (place - 1)), 1, 1) >= '8' THEN -1 ELSE 1 END AS s
  FROM range({SIGN_BITS}) b(j), range(1, {DIMS + 1}) p(place))""", """dcell AS (
  SELECT doc_id, sum(CASE WHEN p > 0 THEN 1 << j ELSE 0 END) AS cell FROM (
    SELECT doc_id, j, sum(value * s) AS p FROM flat JOIN dirs USING (place) GROUP BY 1, 2)
  GROUP BY 1)""", f"""probed AS (
  SELECT query_id, cell FROM (
    SELECT query_id, cell, row_number() OVER (PARTITION BY query_id ORDER BY sum(
             CASE WHEN (cell >> j & 1 = 1) <> (p > 0) THEN abs(p) ELSE 0 END), cell) AS n
    FROM (SELECT query_id, j, sum(value * s) AS p FROM means JOIN dirs USING (place) GROUP BY 1, 2),
         range({1 << SIGN_BITS}) c(cell) GROUP BY 1, 2) WHERE n <= {PROBES})"""], f"""
SELECT * FROM (
  SELECT near.*, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER
    AS rank
  FROM near JOIN dcell USING (doc_id) JOIN probed USING (query_id, cell)) WHERE rank <= {POOL}""")
    rules = [("len >= 0", "document"), ("full_text not null", "document"),
             ("doc_id unique", "document"), ("token unique", "token"),
             ("token_id unique", "token"), ("doc_freq >= 0", "token"),
             ("tf >= 0", "term_doc_stats"), ("(token_id, doc_id) unique", "term_doc_stats"),
             ("doc_id known", "term_doc_stats"), ("token_id known", "term_doc_stats"),
             ("position >= 0", "token_position"),
             ("(doc_id, token_id, position) unique", "token_position"),
             ("doc_id known", "token_position"), ("token_id known", "token_position")]
    kept = " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, '{name}' AS table_name, 0::BIGINT AS violations"
        for rule, name in rules)
    site = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)"
    found = {
        "ingest_corpus": """
SELECT doc_id::VARCHAR AS url, nullif(source, '') AS title,
       concat_ws(chr(10), nullif(source, ''), nullif(text, '')) AS full_text FROM documents""",
        "ingest_pages": f"""
SELECT url, {PAGE_TITLE} AS title, {page_text('html')} AS full_text
FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(url, page_id::VARCHAR) ORDER BY page_id)
      AS n FROM pages) WHERE n = 1""",
        "html_text": f"SELECT page_id, {page_text('html')} AS text FROM pages",
        "html_title": f"SELECT page_id, {PAGE_TITLE} AS title FROM pages",
        "dedupe_url": with_([TURNS], """
SELECT doc_id, url FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY turn) AS n FROM turns)
WHERE n = 1 OR url IS NULL"""),
        "write_index": with_([DOCS, POSITIONS, POSTINGS, DF], """
SELECT doc_id, token, tf, len::INTEGER AS len, doc_freq FROM post JOIN df USING (token)"""),
        "validate_index": with_([TURNS], f"""{kept}
UNION ALL SELECT 'url or title not null', 'document', count(*) FROM turns WHERE url IS NULL
UNION ALL SELECT 'url unique', 'document', count(*) FROM (
  SELECT url FROM turns WHERE url IS NOT NULL GROUP BY url HAVING count(*) > 1)"""),
        "load_queries": "SELECT item_id AS query_id, text FROM benchmark WHERE text <> ''",
        "load_qrels": with_([JUDGED, QRELS], "SELECT * FROM qrels"),
        "link_edges": with_([rf"""clean AS (
  SELECT url, regexp_replace(regexp_replace(html, '<(script|style)\b.*?</(script|style)\s*>', ' ',
    'gis'), '<!--.*?-->', ' ', 'gs') AS html FROM pages)""", rf"""hrefs AS (
  SELECT url, {entities('href')} AS href FROM (
    SELECT url, unnest(regexp_extract_all(html,
      '(?is)<a\s[^>]*?href\s*=\s*["'']([^"''#]+)', 1)) AS href FROM clean))""",
                             f"edges AS (SELECT DISTINCT url, {site} || href AS target FROM hrefs)"],
                            """
SELECT md5('url:' || url) AS from_doc_id, md5('url:' || target) AS to_doc_id FROM edges"""),
        "tokenize_words": f"""
SELECT doc_id, array_to_string({words('text')}, ' ') AS tokens FROM documents""",
        "tokenize_ascii": f"""
SELECT doc_id, array_to_string({ASCII.format('text')}, ' ') AS tokens FROM documents""",
        "lemmatize_vocab": with_([DOCS, POSITIONS, "vocab AS (SELECT DISTINCT token FROM pos)",
                                  "rules(rule, ending, single) AS (VALUES " + ", ".join(
                                      f"({i}, '{a}', '{b}')"
                                      for i, (a, b) in enumerate(NOUN_ENDINGS)) + ")",
                                  "listed(form, lemma) AS (VALUES " + ", ".join(
                                      f"('{a}', '{b}')" for a, b in NOUN_EXCEPTIONS) + ")",
                                  f"""lexicon AS (
  SELECT form, lemma FROM listed
  UNION ALL
  SELECT form, arg_min(lemma, rule) AS lemma
  FROM (SELECT token AS form, rule,
               substr(token, 1, length(token) - length(ending)) || single AS lemma
        FROM vocab JOIN rules ON suffix(token, ending)
          AND length(token) >= length(ending) + {LEAST_STEM}
        WHERE NOT regexp_matches(token, '{NO_PLURAL}'))
  WHERE lemma IN (SELECT token FROM vocab) AND form NOT IN (SELECT form FROM listed)
  GROUP BY form)"""],
                                 """
SELECT coalesce(lemma, token) AS token, count(*) AS n
FROM pos LEFT JOIN lexicon ON form = token GROUP BY 1"""),
        "token_positions": with_([DOCS, POSITIONS], """
SELECT doc_id, position::INTEGER AS position, token FROM pos"""),
        "term_frequency": with_([DOCS, POSITIONS, POSTINGS], "SELECT doc_id, token, tf FROM post"),
        "doc_length": with_([DOCS], "SELECT doc_id, len(tokens)::INTEGER AS len FROM docs"),
        "doc_frequency": with_([DOCS, POSITIONS, POSTINGS, DF], "SELECT token, doc_freq FROM df"),
        "token_dictionary": with_([DOCS, POSITIONS, QUERIES, QUERY_TOKENS], """
SELECT token, 1::BIGINT AS ids FROM (
  SELECT token FROM pos UNION SELECT token FROM qpos)"""),
        "corpus_stats": with_([DOCS], """
SELECT count(*) AS total_docs, sum(len(tokens))::BIGINT AS total_len,
       round(avg(len(tokens)), 9) AS avgdl FROM docs"""),
        "idf_table": with_([DOCS, POSITIONS, POSTINGS, DF, STATS], """
SELECT token, doc_freq,
       round(ln(1e0 + (n - doc_freq + 0.5e0) / (doc_freq + 0.5e0)), 9) AS idf
FROM df CROSS JOIN stats"""),
        "bm25_topk": with_([*CORPUS, f"q AS (SELECT 0::BIGINT AS query_id, '{QUERY}' AS text)",
                            QUERY_TOKENS, SET_TERMS, *bm25("best", 10)], TITLED.format("best")),
        "bm25_batch": with_([*SEARCH, *bm25("best", 1000)],
                            "SELECT query_id, doc_id, score, rank FROM best"),
        "bm25_pruned": with_([*SEARCH, *bm25("best", 10)],
                             "SELECT query_id, doc_id, score, rank FROM best"),
        "bm25_rank_all": with_([*CORPUS, QUERIES, QUERY_TOKENS, BAG_TERMS, *bm25("best", None)], """
SELECT * FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank
  FROM (SELECT q.query_id, docs.doc_id, coalesce(best.score, 0e0) AS score
        FROM q CROSS JOIN docs LEFT JOIN best USING (query_id, doc_id)))
WHERE rank <= 1000"""),
        "bm25_explain": with_([*SEARCH, *bm25("best", 1)], f"""
SELECT qpos.query_id, best.doc_id, qpos.position::INTEGER AS term_index, qpos.token AS term,
       round(coalesce({weight_sql()}, 0e0), 9) AS contribution
FROM best JOIN qpos USING (query_id)
LEFT JOIN post ON post.doc_id = best.doc_id AND post.token = qpos.token
LEFT JOIN df ON df.token = qpos.token CROSS JOIN stats"""),
        "bm25_sweep": with_([*CORPUS, QUERIES, QUERY_TOKENS, BAG_TERMS,
                             "grid(k1, b) AS (VALUES " + ", ".join(
                                 f"({k1}::DOUBLE, {b}::DOUBLE)" for k1, b in SWEEP) + ")"], f"""
SELECT * FROM (
  SELECT *, (row_number() OVER (PARTITION BY k1, b, query_id ORDER BY score DESC, doc_id))::INTEGER
    AS rank
  FROM (SELECT grid.k1, grid.b, terms.query_id, post.doc_id,
               round(sum(terms.weight * {weight_sql('grid.k1', 'grid.b')}), 9) AS score
        FROM post JOIN terms USING (token) JOIN df USING (token) CROSS JOIN stats CROSS JOIN grid
        GROUP BY 1, 2, 3, 4))
WHERE rank = 1"""),
        "vector_topk": exact_neighbours,
        "vector_ann": probed_neighbours,
        "vector_ann_all_cells": exact_neighbours,
        "query_instruction": f"""
SELECT item_id AS query_id, 'Instruct: {QUERY_TASK}' || chr(10) || 'Query: ' || text AS text FROM benchmark WHERE text <> ''""",
        "rrf": with_([*SEARCH, *bm25("a", POOL), *bm25("b", POOL, "0.8e0", "0.3e0"),
                      *fused("rrf", ["a", "b"])], TITLED.format("rrf")),
        "hybrid_search": with_([*SEARCH, *bm25("best", 10), *nearest("near", 10),
                                *fused("rrf", ["best", "near"]), *RERANK_VECTORS,
                                reranked("chosen", "rrf", RCOS, 20, RCOS_JOIN)],
                               TITLED.format("chosen")),
        "legacy_match": with_(MATCHED, """
SELECT query_id, doc_id, times AS num_matched_tokens, frequency::BIGINT AS num_locations
FROM sums"""),
        "legacy_frequency": with_(MATCHED, """
SELECT query_id, doc_id, round(frequency, 9) AS score FROM scaled"""),
        "legacy_position": with_(MATCHED, """
SELECT query_id, doc_id, times, round(position, 9) AS score FROM scaled"""),
        "legacy_normalize": with_([*SEARCH, *bm25("best", POOL)], """
SELECT query_id, doc_id,
       round((score + 1e-5) / (max(score) OVER (PARTITION BY query_id) + 1e-5), 9) AS high,
       round(min(score) OVER (PARTITION BY query_id) / (score + 1e-5), 9) AS low
FROM best"""),
        "legacy_rank": with_(MATCHED, """
SELECT query_id, doc_id, round((1.5e0 * frequency + 1e0 * position * times) / 2.5e0, 9) AS score
FROM scaled"""),
        "rerank": with_([*SEARCH, *bm25("best", POOL), reranked("chosen", "best", OVERLAP, 20)],
                        TITLED.format("chosen")),
        "rerank_cosine": with_([*SEARCH, *bm25("best", POOL), *RERANK_VECTORS,
                                reranked("chosen", "best", RCOS, 20, RCOS_JOIN)],
                               TITLED.format("chosen")),
        "rerank_yes_prob": with_([*SEARCH, *bm25("best", POOL), reranked("chosen", "best", YES, 20)],
                                 TITLED.format("chosen")),
        "rerank_chain": with_([*SEARCH, *bm25("best", POOL), reranked("short_list", "best", OVERLAP, 20),
                               reranked("chosen", "short_list", YES, 10)], TITLED.format("chosen")),
        "l2_normalize": with_([FLAT], unit_places(1 << 30)),
        "truncate_dims": with_([FLAT], unit_places(16)),
        "embed_documents": embedded,
        "embed_batch_policy": f"""
SELECT doc_id, CASE WHEN contains(text, '{REFUSED}') THEN 'refused' END AS embed_error,
       CASE WHEN NOT contains(text, '{REFUSED}') THEN {DIMS} END AS width FROM documents""",
        "backfill_embeddings": with_([DOCS, FLAT, *hashed("dv", "docs", "doc_id", "full_text", DIMS)],
                                     """
SELECT doc_id, (place - 1)::INTEGER AS place, round(value, 9) AS value FROM flat
WHERE doc_id IN (SELECT doc_id FROM docs)
UNION ALL SELECT doc_id, place, round(value, 9) FROM dv
WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"""),
        "reembed_documents": embedded,
        "embedding_audit": """
SELECT count(*) AS docs, count(*) FILTER (embedding IS NULL) AS null_embeddings,
       min(len(embedding))::INTEGER AS min_dim, max(len(embedding))::INTEGER AS max_dim
FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
        "build_run": with_([*SEARCH, *bm25("best", POOL)], """
SELECT 'bm25' AS mode, query_id, url AS doc_id, score, rank FROM best JOIN docs USING (doc_id)"""),
        "precision_at_k": one_metric("precision_at_10"),
        "recall_at_k": one_metric("recall_at_100"),
        "mrr_at_k": one_metric("mrr_at_10"),
        "average_precision": one_metric("average_precision"),
        "ndcg_at_k": one_metric("ndcg_at_10"),
        "evaluate_run": with_([*SEARCH, *bm25("best", 1000),
                               "run AS (SELECT 'bm25' AS mode, * FROM best)", JUDGED, QRELS,
                               *metrics("run", "drop"), EVALUATED], """
SELECT mode, metric, score, scored_queries FROM evaluated"""),
        "compare_modes": with_(ALL_MODES, """
SELECT metric, max(score) FILTER (mode = 'bm25') AS bm25,
       max(score) FILTER (mode = 'vector') AS vector, max(score) FILTER (mode = 'rrf') AS rrf,
       max(score) FILTER (mode = 'reranked') AS reranked FROM evaluated GROUP BY metric"""),
        "eval_resume_modes": with_(ALL_MODES, "SELECT * FROM evaluated"),
        "best_mode": with_(ALL_MODES, """
SELECT metric, mode AS best, score FROM (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY score DESC,
    list_position(['bm25', 'vector', 'rrf', 'reranked'], mode)) AS n FROM evaluated)
WHERE n = 1"""),
        "latency_summary": """
SELECT event_type AS mode, count(*) AS n, round(avg(ms), 6) AS mean_ms,
       round(max(ms) FILTER (pos = target), 6) AS p95_ms
FROM (SELECT event_type, value * 1000e0 AS ms,
             row_number() OVER (PARTITION BY event_type ORDER BY value) AS pos,
             ceil(0.95e0 * count(*) OVER (PARTITION BY event_type)) AS target FROM events)
GROUP BY 1""",
        "eval_resume": with_([*SEARCH, *bm25("best", POOL)],
                             "SELECT query_id, doc_id, score, rank FROM best"),
        "stream_ingest": f"""
WITH arrivals AS (
  SELECT page_id, url, html FROM pages UNION ALL
  SELECT (turn % 2 + 1) * 1000000000000 + conv_id * 100000 + turn,
         CASE WHEN role <> 'system' THEN 'conv://' || conv_id END, text FROM conversations),
docs AS (
  SELECT page_id, url, {PAGE_TITLE} AS title, {words(page_text('html'))} AS tokens
  FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(url, page_id::VARCHAR) ORDER BY page_id)
        AS n FROM arrivals WHERE html IS NOT NULL) WHERE n = 1),
post AS (
  SELECT page_id, token, count(*) AS tf
  FROM (SELECT page_id, unnest(tokens) AS token FROM docs) GROUP BY 1, 2)
SELECT url, title, len(tokens)::INTEGER AS len, token, tf,
       count(*) OVER (PARTITION BY token) AS doc_freq
FROM post JOIN docs USING (page_id)""",
    }
    # The same rows come from an index that has grown.
    return found | {"add_documents": found["write_index"], "stream_segments": found["stream_ingest"]}
