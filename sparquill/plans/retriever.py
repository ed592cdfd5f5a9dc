"""One retriever over a dense and a sparse side, with filters and second-stage ranking."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bm25, dense, filters, fusion, rerank
from ..operators.ranking import ranked
from .config import RetrievalConfig


@dataclass(frozen=True)
class Retriever:
    """docs(doc_id, text, and what filters read); vectors(vec_id = doc_id, embedding); index: a BM25 index."""

    docs: DataFrame
    vectors: DataFrame | None = None
    index: bm25.Bm25Index | None = None

    def _dense(self, queries: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
        if self.vectors is None:
            raise ValueError("the dense side is missing")
        vectors = self.vectors.join((self.docs if allowed is None else allowed).select(F.col("doc_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
        found = dense.with_similarity(dense.search(vectors, queries, k, "l2"))
        return found.select("query_id", F.col("vec_id").alias("doc_id"), "rank", F.col("similarity").alias("score"))

    def _sparse(self, queries: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
        if self.index is None:
            raise ValueError("the sparse side is missing; build an index first")
        scores = bm25.score(self.index, queries)
        if allowed is not None:
            scores = scores.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
        return bm25.top(scores, k).select("query_id", "doc_id", "rank", "score")

    def retrieve(self, queries: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
        """queries(query_id, text, vector) to query_id, rank, doc_id, score."""
        fetch = config.reranker.top_n if config.reranker.enabled else config.top_k
        condition = config.metadata_filter.condition() if config.metadata_filter else None
        allowed = filters.pre_filter(self.docs, condition) if condition is not None and config.filter_mode == "pre" else None
        post = condition is not None and allowed is None
        k = filters.OVERFETCH * fetch if post else fetch
        if config.mode == "dense":
            found = self._dense(queries, k, allowed)
        elif config.mode == "sparse":
            found = self._sparse(queries, k, allowed)
        else:
            h = config.hybrid
            sides = [self._dense(queries, h.candidates, allowed), self._sparse(queries, h.candidates, allowed)]
            texts = self.docs.select("doc_id", "text")
            fused = fusion.fuse(*[s.join(texts, "doc_id") for s in sides], k, (h.dense_weight, h.sparse_weight), h.rrf_k)
            found = fused.select("query_id", "doc_id", "rank", F.col("rrf").alias("score"))
        if post:
            found = filters.post_filter(found, self.docs.drop("text"), condition, fetch).select("query_id", "doc_id", "rank", "score")
        if config.reranker.enabled:
            rows = found.join(self.docs.select("doc_id", "text"), "doc_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
            again = rerank.rerank(rows, top_k=config.reranker.top_k)
            return again.select("query_id", F.col("rerank_rank").alias("rank"), "doc_id", F.col("rerank_score").alias("score"))
        return found.where(F.col("rank") <= config.top_k).select("query_id", "rank", "doc_id", "score")

    def documents(self, queries: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
        """The found documents themselves, in order."""
        return ranked(self.retrieve(queries, config).join(self.docs, "doc_id"), [F.col("rank")], name="position")

    def similarity_search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """The documents of plain dense retrieval, as a vector store gives them."""
        return self.documents(queries, RetrievalConfig(mode="dense", top_k=k))


def retrieve(store: Retriever, queries: DataFrame, k: int = 5, config: RetrievalConfig | None = None) -> DataFrame:
    """The k first documents by a configuration, whatever its own k, or by plain dense retrieval without one."""
    return store.similarity_search(queries, k) if config is None else store.documents(queries, replace(config, top_k=k))
