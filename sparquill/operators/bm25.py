"""BM25 over an inverted index of three tables: postings, document frequencies, one row of statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .ranking import few, top

K1, B = 1.5, 0.75


@dataclass(frozen=True)
class Bm25Index:
    """postings(term, doc_id, tf, dl), df(term, df), stats(n, avgdl, k1, b)."""

    postings: DataFrame
    df: DataFrame
    stats: DataFrame


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), tx.tokens(F.col(text_col)).alias("terms"))
    rows = rows.select("doc_id", F.size("terms").cast("bigint").alias("dl"), F.explode("terms").alias("term"))
    return rows.groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf")).select("term", "doc_id", "tf", "dl")


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def stats(docs: DataFrame, text_col: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """All documents count, those without tokens too."""
    n = F.size(tx.tokens(F.col(text_col)))
    return docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avgdl")).select("n", "avgdl", F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b"))


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B) -> Bm25Index:
    posted = postings(docs, id_col, text_col)
    return Bm25Index(posted, document_frequency(posted), stats(docs, text_col, k1, b))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """One row for each token, so that a repeated token counts again."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(tx.tokens(F.col(text_col))).alias("term"))


def score(index: Bm25Index, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score of all documents that share a term. Postings are cut to the queries' terms before anything is shuffled."""
    terms = query_terms(queries)
    wanted = few(terms.groupBy("term").agg(F.count(F.lit(1)).alias("x")).select("term"))
    cut = index.postings.join(wanted, "term", "left_semi")
    weights = index.df.join(wanted, "term", "left_semi").crossJoin(F.broadcast(index.stats))  # one row of statistics
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = weights.select("term", idf.alias("idf"), "avgdl", "k1", "b")
    asked = terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    # A broadcast is left to the optimiser: weights have one row for each query term at most.
    hits = cut.join(weights, "term").join(few(asked), "term")
    part = F.col("times") * F.col("idf") * F.col("tf") * (F.col("k1") + 1) / (F.col("tf") + F.col("k1") * (1 - F.col("b") + F.col("b") * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score")).where("score > 0")


def search(index: Bm25Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, doc_id, score."""
    return top(score(index, queries), k).select("query_id", "rank", "doc_id", "score")


def save(index: Bm25Index, path: str) -> None:
    """Postings sorted by term, so that questions read the parts of their terms; frequencies are counted on what was written."""
    index.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    document_frequency(index.postings.sparkSession.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/df")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")


def load(spark, path: str) -> Bm25Index:
    return Bm25Index(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "df", "stats")])
