"""Second-stage ranking by a scorer of (question, text) pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .ranking import ranked


def overlap_score(query: Column, text: Column) -> Column:
    """Stand-in for a cross-encoder: share of the question's distinct tokens that the text has."""
    q = F.array_distinct(tx.tokens(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, tx.tokens(text))), F.size(q)), F.lit(0.0))


def rerank(candidates: DataFrame, scorer: Callable[[Column, Column], Column] = overlap_score, top_k: int = 5) -> DataFrame:
    """candidates(query_id, query, doc_id, text, rank, score): adds rerank_score and rerank_rank, keeps top_k. Ranks are given before the cut; ties keep the old order."""
    scored = candidates.withColumn("rerank_score", F.round(F.coalesce(scorer(F.col("query"), F.col("text")), F.lit(0.0)), 6))
    out = ranked(scored, [F.desc("rerank_score"), F.col("rank")], name="rerank_rank").where(F.col("rerank_rank") <= top_k)
    return out.select("query_id", "doc_id", F.col("rank").alias("original_rank"), "rerank_rank", F.col("score").alias("original_score"), "rerank_score")
