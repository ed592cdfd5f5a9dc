"""Reciprocal rank fusion of a dense and a sparse list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ranked


def shares(weights: list[float]) -> list[float]:
    if len(weights) != 2:
        raise ValueError("two lists need two weights")
    if sum(weights) == 0:
        raise ValueError("the weights sum to zero")
    return [w / sum(weights) for w in weights]


def fuse(dense: DataFrame, sparse: DataFrame, top_k: int | None = 5, weights: tuple[float, float] = (0.7, 0.3), k: int = 60, key: str = "text") -> DataFrame:
    """Lists of query_id, doc_id, rank, score (and text, if it is the key) to query_id, rank, doc_id, rrf and each list's rank and score.

    Rows of one key sum up their 1 / (k + rank), also those of one list; the rank, score and document shown are those of
    the last one, the sparse list before the dense. Ties keep the order in which keys were met.
    """
    w = shares(list(weights))
    columns = ["query_id", "doc_id", "rank", "score"] + (["text"] if key == "text" else [])
    one = lambda df, i: df.select(*columns).withColumns({"list": F.lit(i), "part": F.lit(w[i]) / (k + F.col("rank"))})
    both = one(dense, 0).unionByName(one(sparse, 1))
    last = lambda i: F.max(F.when(F.col("list") == i, F.struct("rank", "score")))
    fused = both.groupBy("query_id", key).agg(
        F.round(F.sum("part"), 6).alias("rrf"),
        F.min(F.struct("list", "rank")).alias("met"),
        F.max(F.struct("list", "rank", "doc_id"))["doc_id"].alias("__doc"),
        last(0).alias("d"),
        last(1).alias("s"),
    )
    fused = fused.select("query_id", F.col("__doc").alias("doc_id"), "rrf", "met", F.col("d.rank").alias("dense_rank"), F.col("d.score").alias("dense_score"), F.col("s.rank").alias("sparse_rank"), F.col("s.score").alias("sparse_score"))
    out = ranked(fused, [F.desc("rrf"), F.col("met.list"), F.col("met.rank")]).drop("met")
    return out if top_k is None else out.where(F.col("rank") <= top_k)
