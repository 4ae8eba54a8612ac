"""The queries of the operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_dir
from . import (centroids, chat, chunks, decontaminate, language, line_dedup, packing,
               quality_classifier, quality_rules, sampling, simhash, spelling, token_files,
               toxicity)
from .common import table

VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
CONFLICT = "<|im_end|><|im_start|>assistant ok"


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnable = docs.filter((sampling.fold("doc_id", 4) != 2) & F.col("lang").isNotNull()
                            & F.col("text").isNotNull())
    models = language.train(learnable.select("doc_id", "text", F.col("lang").alias("label")))
    return language.identify(docs, ["doc_id"], models).select(
        "doc_id", F.coalesce(sampling.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "lang_pred", "score")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), ["doc_id"],
                               table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"),
                        lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary())
    return token_files.document_digests(spark, path)


def learnable(spark: SparkSession, sf_dir: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Documents outside the held-out fold, and labels (`doc_id, label`).

    A document labelled more than once has its largest label.
    """
    labels = (table(spark, sf_dir, "labels").filter(F.col(label).isNotNull())
              .groupBy("doc_id").agg(F.max(label).alias("label")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.filter((sampling.fold("doc_id", 5) != 0) & F.col("text").isNotNull()), labels


def _scored(found: DataFrame, least: float) -> DataFrame:
    return found.select(
        "doc_id", F.coalesce(sampling.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality_classifier.train(*learnable(spark, sf_dir, "quality"))
    docs = table(spark, sf_dir, "documents")
    return _scored(quality_classifier.score(docs, ["doc_id"], model), 0.3)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.remove_repeated_runs(
        table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.train(*learnable(spark, sf_dir, "toxic"))
    docs = table(spark, sf_dir, "documents")
    return _scored(toxicity.score(docs, ["doc_id"], model), 0.5)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, sf_dir, "documents"), ["doc_id"])
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "failures", (~quality_rules.kept("base")).alias("base_failed"),
        quality_rules.kept("v1").alias("kept"))


def token_digests(docs: DataFrame) -> DataFrame:
    done = chunks.encode_decode(docs, ["doc_id"], vocabulary())
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(
        "SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(t.turn AS BIGINT) AS turn, t.role, "
        "'<|im_end|><|im_start|>assistant ok' AS text "
        "FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    path = scratch_dir(spark, "chat")
    chat.format_conversations(rows.unionByName(extra)).write.parquet(path)
    done = spark.read.parquet(path)
    turns = chat.parse(F.col("formatted"))
    loss = chat.masked_text(F.col("formatted"), F.col("loss_spans"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size(turns).cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(table(spark, sf_dir, "documents")))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"),
                        public_tokenizers.path(BYTE_VOCABULARY))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.summary(centroids.cluster_vectors(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_files": op3_token_files,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_line_dedup": op5_line_dedup,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op9_chunk_bpe": op9_chunk_bpe,
    "op10_chat": op10_chat,
    "op11_spelling": op11_spelling,
    "op12_packing": op12_packing,
    "op13_centroids": op13_centroids,
}

SQL: dict[str, str] = {}

SQL["op2_decontaminate"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size,
         array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
        FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
found AS (
  SELECT DISTINCT d.doc_id, d.i, d.size, v.item_id
  FROM (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
        FROM (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i
              FROM words, sizes WHERE len(w) >= size)) d
  JOIN windows v ON v.size = d.size AND v.win = d.win),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

SQL["op5_line_dedup"] = r"""
WITH docs AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l
  FROM documents),
lines AS (
  SELECT doc_id, i, len(regexp_extract_all(l[i], '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM docs)),
sums AS (
  SELECT doc_id, i, n, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM lines),
reach AS (
  SELECT a.doc_id, a.i AS start, b.i AS stop FROM sums a JOIN sums b
  ON a.doc_id = b.doc_id AND a.i <= b.i AND b.c - a.c + a.n >= 20),
runs AS (
  SELECT doc_id, start, min(stop) AS stop FROM reach GROUP BY doc_id, start
  UNION SELECT doc_id, max(start), stop FROM reach GROUP BY doc_id, stop),
placed AS (
  SELECT doc_id, start, stop, row_number() OVER (
           PARTITION BY array_to_string(l[start:stop], chr(10)) ORDER BY doc_id, start) AS nth
  FROM runs JOIN docs USING (doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, stop + 1)) AS i FROM placed WHERE nth > 1),
kept AS (
  SELECT doc_id, count(g.i) AS n_removed, count(*) AS n_lines,
         string_agg(CASE WHEN g.i IS NULL THEN l[d.i] END, chr(10) ORDER BY d.i) AS text
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM docs) d
  LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS text_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

SQL["op8_quality_rules"] = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM texts),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)),
twice AS (SELECT doc_id, win FROM windows GROUP BY doc_id, win HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM windows JOIN twice USING (doc_id, win))
  GROUP BY doc_id),
measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_same
  FROM words LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
    + (CASE WHEN n_dup_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN 2 * n_upper > word_chars THEN 64 ELSE 0 END)
    + (CASE WHEN n_words > 100000 THEN 128 ELSE 0 END)
    + (CASE WHEN 3 * n_same > n_words THEN 256 ELSE 0 END) AS BIGINT) AS failures
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures,
       (failures & 3) <> 0 AS base_failed, (failures & 383) = 0 AS kept
FROM judged
"""

SQL["op10_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok'
  FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
escaped AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS written FROM turns),
told AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ''
                             ORDER BY turn, role, text), '') AS loss,
         sum(length('<|im_start|><|im_end|>') + 2 + length(role) + length(text)) AS raw_chars,
         sum(length('<|im_start|><|im_end|>') + 2 + length(role) + length(written)) AS escaped_chars,
         bool_or(regexp_matches(text, '<\\+\||<\|im_(start|end)\|>')) AS conflict
  FROM escaped GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n_turns AS BIGINT) AS n_turns,
       sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256,
       CAST(CASE WHEN conflict THEN escaped_chars ELSE raw_chars END AS BIGINT) AS formatted_chars
FROM told
"""


def _rounds_sql(k: int = 8, rounds: int = 10, width: int = 64) -> str:
    """All rounds over all distances, one pair of tables a round."""
    far = (f"list_sum(list_transform(range(1, {width + 1}), "
           "lambda i: (x[i] - c[i]) * (x[i] - c[i])))")

    def assigned(turn: int) -> str:
        return (f"a{turn} AS MATERIALIZED (SELECT r, j, d FROM (SELECT r, j, {far} AS d, "
                f"row_number() OVER (PARTITION BY r ORDER BY {far}, j) AS nth "
                f"FROM kept, c{turn}) WHERE nth = 1)")

    def moved(turn: int) -> str:
        return (f"c{turn + 1} AS MATERIALIZED (SELECT j, coalesce(m, c) AS c FROM c{turn} LEFT JOIN ("
                "SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS m FROM ("
                "SELECT j, p, CAST(sum(x[p]) AS BIGINT) AS s, count(*) AS n "
                f"FROM a{turn} JOIN kept USING (r), (SELECT unnest(range(1, {width + 1})) AS p) "
                "GROUP BY j, p) GROUP BY j) USING (j))")

    steps = [x for turn in range(rounds) for x in (assigned(turn), moved(turn))]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda v: CAST(floor(1024 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {width}
    AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {width}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS j, x AS c
  FROM (SELECT sha256('3:' || vec_id) AS h, x FROM kept ORDER BY h NULLS LAST, x LIMIT {k})),
{("," + chr(10)).join([*steps, assigned(rounds)])},
sums AS (SELECT j, sum(d) AS cluster_inertia FROM a{rounds} GROUP BY j)
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(cluster_inertia AS BIGINT) AS cluster_inertia,
       CAST((SELECT sum(cluster_inertia) FROM sums) AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (j) JOIN sums USING (j)
"""


SQL["op13_centroids"] = _rounds_sql()
