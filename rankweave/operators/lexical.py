"""From documents to the tables of an inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scoring
from ..functions.text import Analyzer, run_lengths, run_starts, words
from ..session import lookup_join


def token_id(token: Column) -> Column:
    """A stable id: it needs no counter, no global order, and is the same in every run."""
    return F.xxhash64(token)


def analyze(documents: DataFrame, analyzer: Analyzer = words,
            text: str = "full_text") -> DataFrame:
    """Add `tokens` and `len`, the number of tokens; an empty document keeps its row."""
    analyzed = documents.withColumn("tokens", analyzer(F.col(text)))
    return analyzed.withColumn("len", F.size("tokens"))


def token_positions(analyzed: DataFrame) -> DataFrame:
    """One row per token occurrence, positions counted from 0 after filtering."""
    # The outer form keeps the planner from testing the size of `tokens` first, which would
    # run the analyzer twice.
    return (analyzed.select("doc_id", F.posexplode_outer("tokens").alias("position", "token"))
            .filter(F.col("token").isNotNull()))


def lemmatize(rows: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """Replace `token` by its lemma from a `(form, lemma)` table; unknown forms stay.

    Extra columns are kept. The lexicon has one lemma per form: two of them are an error, a repeated
    row is not.
    """
    if lexicon is None:
        return rows
    lemma = F.when(F.min("lemma").eqNullSafe(F.max("lemma")), F.min("lemma")).otherwise(
        F.raise_error(F.concat(F.lit("the lexicon has two lemmas for "), F.col("form")))
        .cast("string"))
    forms = lexicon.groupBy("form").agg(lemma.alias("_lemma")).withColumnRenamed("form", "token")
    joined = lookup_join(rows, forms, "token", how="left")
    return (joined.withColumn("token", F.coalesce("_lemma", "token")).drop("_lemma")
            .select(*rows.columns))


# Endings of plural nouns, what stands in their place in the singular, longest first.
NOUN_ENDINGS = (("ches", "ch"), ("shes", "sh"), ("ses", "s"), ("xes", "x"), ("zes", "z"),
                ("ves", "f"), ("ves", "fe"), ("ies", "y"), ("men", "man"), ("s", ""))
# Plurals by no rule.
NOUN_EXCEPTIONS = (("children", "child"), ("feet", "foot"), ("geese", "goose"), ("lice", "louse"),
                   ("mice", "mouse"), ("oxen", "ox"), ("teeth", "tooth"))
# Words in these are singular, or too short to tell.
NO_PLURAL = "(ss|us|is)$"
LEAST_STEM = 2


def noun_lexicon(vocabulary: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """`(form, lemma)` of the plurals in a vocabulary (`token`, each word once), for `lemmatize`.

    An ending is taken off, by the first rule whose result is a word of the vocabulary too; so a
    word that only looks like a plural stays as it is. Exceptions (`form`, `lemma`; the fixed ones by
    default) come before the rules and need not be in the vocabulary. Rules work on the distinct
    words, and the candidates are joined with them, so no text is touched.
    """
    if exceptions is None:
        exceptions = vocabulary.sparkSession.createDataFrame(
            list(NOUN_EXCEPTIONS), "form string, lemma string")
    words_ = vocabulary.select("token")
    candidates = F.array(*[
        F.when(F.endswith("token", F.lit(ending)) & (F.length("token") >= len(ending) + LEAST_STEM),
               F.concat(F.expr(f"substring(token, 1, length(token) - {len(ending)})"),
                        F.lit(single)))
        for ending, single in NOUN_ENDINGS])
    plural = words_.filter(~F.col("token").rlike(NO_PLURAL)).select(
        F.col("token").alias("form"), F.posexplode(candidates).alias("rule", "lemma"))
    by_rule = (plural.filter(F.col("lemma").isNotNull())
               .join(words_.withColumnRenamed("token", "lemma"), "lemma", "left_semi")
               .groupBy("form").agg(F.min_by("lemma", "rule").alias("lemma")))
    known = exceptions.select("form", "lemma").distinct()
    # A few words; those of the vocabulary that the table names.
    listed = words_.select(F.col("token").alias("form")).join(known, "form")
    return by_rule.join(known, "form", "left_anti").select("form", "lemma").unionByName(listed)


def term_frequency(analyzed: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Postings `(doc_id, token, tf, len)`.

    Terms are counted inside each document row, by the run lengths of its sorted tokens, so no
    occurrence is ever shuffled. Only with a lexicon two forms of a document may meet in one lemma
    and are added up afterwards.
    """
    # Each step is a column of its own that the next refers to more than once: the planner then
    # keeps the steps apart instead of sorting again for every use.
    ordered = analyzed.select("doc_id", "len", F.sort_array("tokens").alias("_sorted"))
    runs = ordered.withColumn("_starts", run_starts(F.col("_sorted")))
    counted = F.arrays_zip(
        F.array_distinct("_sorted").alias("token"),
        run_lengths(F.col("_starts"), F.size("_sorted")).alias("tf"))
    postings = (runs.select("doc_id", "len", F.inline_outer(counted))
                .filter(F.col("token").isNotNull())
                .select("doc_id", "token", "tf", "len"))
    if lexicon is None:
        return postings
    return (lemmatize(postings, lexicon).groupBy("doc_id", "token")
            .agg(F.sum("tf").alias("tf"), F.first("len").alias("len")))


def doc_length(analyzed: DataFrame) -> DataFrame:
    return analyzed.select("doc_id", "len")


def doc_frequency(postings: DataFrame) -> DataFrame:
    """Documents per token; a frequent token is counted in every map task first."""
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("doc_freq"))


def token_dictionary(tokens: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """`(token_id, token)` for every distinct token, known tokens keeping their id."""
    distinct = tokens.select("token").distinct()
    if existing is None:
        return distinct.select(token_id(F.col("token")).alias("token_id"), "token")
    new = distinct.join(existing.select("token"), "token", "left_anti")
    added = new.select(token_id(F.col("token")).alias("token_id"), "token")
    return existing.select("token_id", "token").unionByName(added)


def corpus_stats(documents: DataFrame) -> DataFrame:
    """One row: number of documents and average length, empty documents included."""
    return documents.agg(
        F.count(F.lit(1)).alias("total_docs"),
        F.sum(F.col("len").cast("long")).alias("total_len"),
        F.avg("len").alias("avgdl"),
    )


def idf_table(tokens: DataFrame, stats: DataFrame) -> DataFrame:
    """`(token, doc_freq, idf)`; the one-row statistics enter as a scalar subquery."""
    total = stats.select("total_docs").scalar()
    return tokens.select("token", "doc_freq",
                         scoring.idf(total, F.col("doc_freq")).alias("idf"))


def link_edges(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Links `(from_doc_id, to_doc_id)` between known documents.

    `pages` holds `url` and `links`, an array of targets. Relative targets are resolved against
    the page's address; a link to an unknown page is dropped and repeats count once.
    """
    ids = documents.select("doc_id", "url").filter(F.col("url").isNotNull())
    target = F.col("href")
    site = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    folder = F.regexp_extract("url", r"^(.*/)", 1)
    resolved = (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
                .when(target.startswith("//"),
                      F.concat(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), target))
                .when(target.startswith("/"), F.concat(site, target))
                .otherwise(F.concat(folder, target)))
    # Repeats are removed before the joins, so a target linked from everywhere costs one row
    # per linking page.
    edges = (pages.select("url", F.explode("links").alias("href"))
             .select("url", resolved.alias("to_url")).distinct())
    return (edges.join(ids.withColumnRenamed("doc_id", "from_doc_id"), "url")
            .select("from_doc_id", "to_url")
            .join(ids.select(F.col("doc_id").alias("to_doc_id"), F.col("url").alias("to_url")),
                  "to_url")
            .select("from_doc_id", "to_doc_id").distinct())
