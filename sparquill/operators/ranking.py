"""Ranked lists: tables of query_id, rank, an id and a score.

Scores are rounded to six digits before they order rows, and ties go to the smaller id, so that equal scores rank alike
on every run and engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that may be broadcast without more thought.
FEW = 200_000


def few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """df, broadcast if a count shows it to be small; else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def ranked(df: DataFrame, order: list[Column], by: list[str] = ["query_id"], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))


def top(df: DataFrame, k: int, score: str = "score", id_col: str = "doc_id", by: list[str] = ["query_id"]) -> DataFrame:
    """The k highest rounded scores of each query, with their ranks. Spark cuts each partition to k before the shuffle."""
    rounded = df.withColumn(score, F.round(score, 6))
    return ranked(rounded, [F.desc(score), F.col(id_col)], by).where(F.col("rank") <= k)


def round_robin(lists: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """lists(by, hop, rank, doc_id, text): documents of all hops in turn, each text's first 200 characters once, 2 k at most."""
    first = Window.partitionBy(by, F.substring("text", 1, 200)).orderBy("rank", "hop")
    once = lists.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return ranked(once, [F.col("rank"), F.col("hop")], [by], "position").where(F.col("position") <= 2 * k)
