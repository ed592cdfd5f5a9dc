"""Exact vector search: blocks of queries against all vectors.

A block of queries (about BLOCK of them, a size that is checked by a count) is broadcast; each task multiplies batches of
vectors with as many queries at a time as make CELLS scores, and passes on the k best rows of a batch for each query
only. A window merges them. Each further block takes another pass over the vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ranked, top

BLOCK, CELLS = 1 << 17, 1 << 21


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Rows of q by rows of x; the larger the nearer."""
    product = q @ x.T
    if metric == "dot":
        return product
    if metric == "cosine":
        n = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None]
        return np.where(n == 0, 0.0, product / np.where(n == 0, 1.0, n))
    if metric == "l2":
        return -np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * product, 0.0)
    raise ValueError(f"unknown metric {metric!r}")


def best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest scores of each row, ties to the smaller id."""
    if s.shape[1] > k:
        rows, at = np.nonzero(s >= np.partition(s, -k, axis=1)[:, -k][:, None])
    else:
        rows, at = (x.ravel() for x in np.indices(s.shape))
    order = np.lexsort((ids[at], -s[rows, at], rows))
    rows, at = rows[order], at[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], at[keep]


def _block(vectors: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    rows = queries.toArrow()  # BLOCK rows, about
    ids = rows.column("query_id").to_numpy()
    q = np.array(rows.column("vector").to_pylist(), np.float64).reshape(len(ids), -1)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches):
        ids, q = shared.value
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            vec_ids = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec_ids), -1)
            step = max(1, CELLS // len(vec_ids))
            for begin in range(0, len(ids), step):
                s = np.round(_scores(x, q[begin : begin + step], metric), 6)
                rows, at = best(s, vec_ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[begin + rows]), pa.array(vec_ids[at]), pa.array(s[rows, at])], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, metric: str = "l2") -> DataFrame:
    """vectors(vec_id, embedding), queries(query_id, vector) to query_id, rank, vec_id, score.

    ``score`` is the cosine, the product, or the negative squared distance. Rows without a vector take no part.
    """
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding").where("embedding is not null")
    queries = queries.select(F.col("query_id").cast("long"), "vector").where("vector is not null")
    blocks = max(1, -(-queries.count() // BLOCK))
    parts = [_block(vectors, queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), k, metric) for i in range(blocks)]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return top(found, k, id_col="vec_id").select("query_id", "rank", "vec_id", "score")


def with_similarity(found: DataFrame) -> DataFrame:
    """distance and similarity 1 / (1 + distance) of an l2 list, ranked by similarity."""
    out = found.withColumn("distance", F.round(-F.col("score"), 6) + 0.0).drop("score")
    return out.withColumn("similarity", F.round(1 / (1 + F.col("distance")), 6))


def with_rank_scores(lists: DataFrame) -> DataFrame:
    """1 / rank where a store gives no scores."""
    return lists.withColumn("score", F.round(F.coalesce("score", 1.0 / F.col("rank")), 6))


def rerank_positions(lists: DataFrame) -> DataFrame:
    return ranked(lists, [F.desc("score"), F.col("doc_id")])
