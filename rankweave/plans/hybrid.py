"""Retrievers, fusion and rerankers put together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.text import query_instruction
from ..operators.bm25 import attach_titles, bm25_topk
from ..operators.embed import EmbedFunction, EmbedPolicy, embed_documents
from ..operators.fusion import reciprocal_rank_fusion
from ..operators.vector import vector_topk
from ..session import materialize
from ..sources.index import LexicalIndex

# Queries `(query_id, text)` in, ranking out.
Retriever = Callable[[DataFrame], DataFrame]
# Queries and a ranking in, a new ranking out.
Ranker = Callable[[DataFrame, DataFrame], DataFrame]


def embed_queries(queries: DataFrame, embed: EmbedFunction, dims: int | None = None,
                  instruct: bool = True, policy: EmbedPolicy = EmbedPolicy()) -> DataFrame:
    """`(query_id, embedding)`; queries are wrapped in the instruction, documents are not."""
    text = query_instruction(F.col("text")) if instruct else F.col("text")
    return embed_documents(queries.select("query_id", text.alias("full_text")), embed,
                           dims=dims, policy=policy).select("query_id", "embedding")


def bm25_retriever(index: LexicalIndex, k1: float | None = None, b: float | None = None,
                   top_k: int | None = None) -> Retriever:
    def retrieve(queries: DataFrame) -> DataFrame:
        return attach_titles(bm25_topk(index, queries, k1, b, top_k), index.document)
    return retrieve


def vector_retriever(documents: DataFrame, embed: EmbedFunction, titles: DataFrame | None = None,
                     top_k: int = 10, dims: int | None = None,
                     instruct: bool = True) -> Retriever:
    """`documents` holds `(doc_id, embedding)`, `titles` holds `(doc_id, title)`."""
    def retrieve(queries: DataFrame) -> DataFrame:
        vectors = materialize(embed_queries(queries, embed, dims, instruct))
        ranking = vector_topk(documents, vectors, top_k)
        return ranking if titles is None else attach_titles(ranking, titles)
    return retrieve


def rerank_chain(queries: DataFrame, ranking: DataFrame, rankers: list[Ranker]) -> DataFrame:
    """Apply rankers one after the other, each on what the one before kept.

    Rankings are small and each stage is written down, so a model is asked once per candidate.
    """
    for ranker in rankers:
        ranking = ranker(queries, materialize(ranking))
    return ranking


@dataclass
class HybridSearch:
    """Ask all retrievers, fuse their rankings, then apply the rankers in order.

    Without rankers the fused ranking is the result, whole.
    """
    retrievers: list[Retriever]
    rankers: list[Ranker] = field(default_factory=list)
    rrf_k: int = 60

    def search(self, queries: DataFrame) -> DataFrame:
        fused = reciprocal_rank_fusion([r(queries) for r in self.retrievers], self.rrf_k)
        return rerank_chain(queries, fused, self.rankers)
