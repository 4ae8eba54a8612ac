"""Reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scoring
from ..session import union_all
from .topk import top_k


def stack_rankings(rankings: list[DataFrame]) -> DataFrame:
    """All lists below each other, marked by their place in the argument."""
    return union_all([
        ranking.select("query_id", "doc_id", "rank",
                       (F.col("doc_title") if "doc_title" in ranking.columns
                        else F.lit(None).cast("string")).alias("doc_title"))
        .withColumn("list_idx", F.lit(i))
        for i, ranking in enumerate(rankings)
    ])


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """Add `1 / (k + rank)` over the lists; nothing is cut.

    The title seen last wins. Equal scores keep the order in which the documents were first
    seen: by list, then by rank.
    """
    if not rankings:
        raise ValueError("give at least one ranking")
    seen = F.struct("list_idx", "rank")
    fused = (stack_rankings(rankings)
             .groupBy("query_id", "doc_id")
             .agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"),
                  F.max_by(F.struct("doc_title"), seen).getField("doc_title").alias("doc_title"),
                  F.min(seen).alias("_first"))
             .withColumn("score", scoring.rounded(F.col("score"), scoring.RRF_DIGITS)))
    ranked = top_k(fused, ["query_id"], [F.col("score").desc(), F.col("_first").asc()], None)
    return ranked.select("query_id", "doc_id", "doc_title", "score", "rank")
