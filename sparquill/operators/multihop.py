"""Multi-hop retrieval: sub-questions are searched all at once and interleaved."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .ranking import round_robin


def sub_queries(queries: DataFrame, most: int = 3) -> DataFrame:
    """queries(query_id, text) to query_id, hop, sub_query, intent; simple questions stay whole."""
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("hop"), F.col("text").alias("sub_query"), F.lit("original").alias("intent")))
    parts = F.when(tx.is_complex(F.col("text")), tx.decompose(F.col("text"), most)).otherwise(whole)
    return queries.select("query_id", F.explode(parts).alias("p")).select("query_id", "p.hop", "p.sub_query", "p.intent")


def search(queries: DataFrame, docs: DataFrame, retrieve: Callable[[DataFrame, int], DataFrame], top_k: int = 5, most: int = 3) -> DataFrame:
    """``retrieve`` takes (query_id, text) and k and returns query_id, rank, doc_id; docs(doc_id, text). Gives query_id, position, hop, doc_id."""
    hops = sub_queries(queries, most).withColumn("hop_id", F.xxhash64("query_id", "hop"))
    found = retrieve(hops.select(F.col("hop_id").alias("query_id"), F.col("sub_query").alias("text")), top_k)
    lists = found.withColumnRenamed("query_id", "hop_id").join(hops.select("hop_id", "query_id", "hop"), "hop_id").join(docs.select("doc_id", "text"), "doc_id")
    return round_robin(lists, top_k).select("query_id", "position", "hop", "doc_id")
