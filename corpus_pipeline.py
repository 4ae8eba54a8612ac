"""From raw documents to token ids in five stages, each one an operator of `rankweave.llm`.

A stage takes the documents its predecessor kept and returns them with their columns; the last
returns the ids' digests. Nulls, empty texts, repeated rows and further columns are treated as the
operators state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankweave.llm import decontaminate, line_dedup, quality_rules, queries, simhash
from rankweave.llm.common import table
from rankweave.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass policy v1 of the quality rules."""
    return quality_rules.filter_documents(docs, "v1")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of repeated runs of lines; `n_chars` follows the
    text. A document all of whose lines go stays, with an empty text."""
    names = docs.columns
    # Under names of their own, so that the operator's counts do not take the place of a column.
    plain = docs.select(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(names)])
    done = line_dedup.remove_repeated_runs(
        plain, f"d{names.index('doc_id')}", f"d{names.index('text')}").select(
        *[F.col(f"d{i}").alias(c) for i, c in enumerate(names)])
    if "n_chars" not in names:
        return done
    kind = docs.schema["n_chars"].dataType
    return done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                           .otherwise(F.length("text").cast(kind)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates: fingerprints of three-word
    shingles, linked at three bits or fewer."""
    return simhash.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark text occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id, n_tokens, ids_sha256, decoded_sha256` of every document."""
    return queries.token_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("bpe_encoding", tokens),
]

# Hashes of shingles and byte-pair merges are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
