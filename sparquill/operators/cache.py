"""Semantic cache over tables: lookup, expiry, bounded size, statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dense


@dataclass(frozen=True)
class CacheConfig:
    threshold: float = 0.92
    max_entries: int = 1000
    ttl_seconds: float | None = None

    def __post_init__(self):
        if not 0 <= self.threshold <= 1:
            raise ValueError("the threshold lies between 0 and 1")
        if self.max_entries < 1:
            raise ValueError("a cache holds an entry at least")
        if self.ttl_seconds is not None and self.ttl_seconds <= 0:
            raise ValueError("a time to live is positive")


def lookup(entries: DataFrame, probes: DataFrame, config: CacheConfig = CacheConfig()) -> DataFrame:
    """entries(vec_id, embedding), probes(query_id, vector) to probe_id, hit, entry_id, similarity; the first of the most similar wins, a zero probe matches nothing."""
    best = dense.search(entries, probes, 1, "cosine").select("query_id", F.col("vec_id").alias("entry_id"), F.col("score").alias("similarity"))
    out = probes.select("query_id").join(best, "query_id", "left")
    hit = F.coalesce(F.col("similarity") >= config.threshold, F.lit(False))
    return out.select(F.col("query_id").alias("probe_id"), hit.alias("hit"), F.when(hit, F.col("entry_id")).alias("entry_id"), "similarity")


def alive(entries: DataFrame, now: Column, ttl_seconds: float, at: str = "ts") -> DataFrame:
    """Entries that are not older than the time to live."""
    return entries.where((now.cast("timestamp").cast("double") - F.col(at).cast("timestamp").cast("double")) <= ttl_seconds)


def newest(entries: DataFrame, most: int, at: str = "ts", id_col: str = "event_id", by: list[str] = []) -> DataFrame:
    """First in, first out: the newest entries stay, of each shard if ``by`` names one. Without shards this is a top-k."""
    if not by:
        return entries.orderBy(F.desc(at), F.desc(id_col)).limit(most)
    order = Window.partitionBy(*by).orderBy(F.desc(at), F.desc(id_col))
    return entries.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def statistics(looked_up: DataFrame) -> DataFrame:
    """hits, misses, total, hit_rate (0 without lookups)."""
    hits, total = F.count_if("hit"), F.count(F.lit(1))
    return looked_up.agg(hits.alias("hits"), (total - hits).alias("misses"), total.alias("total"), F.round(F.coalesce(F.try_divide(hits, total), F.lit(0.0)), 6).alias("hit_rate"))
