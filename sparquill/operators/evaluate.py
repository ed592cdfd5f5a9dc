"""Evaluation: samples, metrics, experiment grids, reports. Metrics are token overlaps, stand-ins for a judging model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

JUDGED_TYPES = ("combination", "image", "combination (table and text)")


def grid(spark: SparkSession, stores: list[str], modes: list[str], ks: list[int], reranked: list[bool]) -> DataFrame:
    """All configurations: store, mode, k, reranked. The lists are a caller's few settings, not data."""
    rows = [(s, m, k, r) for s in stores for m in modes for k in ks for r in reranked]
    return spark.createDataFrame(rows, "store string, mode string, k bigint, reranked boolean")


def coverage(of: Column, by: Column) -> Column:
    """Share of the distinct tokens of one text that the other has; 0 without tokens."""
    x = F.array_distinct(tx.tokens(of))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(x, tx.tokens(by))), F.size(x)), F.lit(0.0)), 6)


def metrics(question: Column, answer: Column, contexts: Column, truth: Column, enough: float = 0.1) -> Column:
    """struct of faithfulness, answer_relevance, context_precision, context_recall; the last two are 0 without contexts."""
    joined = F.array_join(contexts, "\n\n")
    useful = F.size(F.filter(contexts, lambda c: coverage(question, c) >= enough))
    return F.struct(
        coverage(answer, joined).alias("faithfulness"),
        coverage(question, answer).alias("answer_relevance"),
        F.round(F.coalesce(F.try_divide(useful, F.size(contexts)), F.lit(0.0)), 6).alias("context_precision"),
        coverage(truth, joined).alias("context_recall"),
    )


def hits(lists: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """lists(mode, query_id, doc_id, rank), truth(query_id, doc_id) to hit_rate, mrr and recall by mode and k, over the queries that have a truth."""
    found = lists.join(truth, ["query_id", "doc_id"]).select("mode", "query_id", "rank", F.explode(F.array(*[F.lit(k).cast("bigint") for k in ks])).alias("k")).where("rank <= k")
    found = found.groupBy("mode", "query_id", "k").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    asked = truth.groupBy("query_id").agg(F.countDistinct("doc_id").alias("relevant"))
    every = asked.crossJoin(F.broadcast(lists.select("mode").distinct())).select("query_id", "relevant", "mode", F.explode(F.array(*[F.lit(k).cast("bigint") for k in ks])).alias("k"))
    both = every.join(found, ["mode", "query_id", "k"], "left")
    mean = lambda c, name: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6).alias(name)
    return both.groupBy("mode", "k").agg(mean(F.when(F.col("first").isNotNull(), 1.0), "hit_rate"), mean(1.0 / F.col("first"), "mrr"), mean(F.col("n") / F.col("relevant"), "page_recall"))


def is_judged(content_type: Column) -> Column:
    return F.coalesce(content_type.isin(*JUDGED_TYPES), F.lit(False))


def judged(samples: DataFrame, verdict: Column, content_type: str = "content_type") -> DataFrame:
    """samples with judge_score and judge_reasoning, null where the content type isn't judged.

    ``verdict``: a judging model's JSON answer. What is missing or doesn't parse is an error of the judge and scores 0.
    """
    from .prompts import parsed

    v = parsed(verdict, "score double, reasoning string")
    failed = v["failed"] | v["value"]["score"].isNull()
    chosen = is_judged(F.col(content_type))
    score = F.when(failed, 0.0).otherwise(v["value"]["score"])
    reason = F.when(failed, F.lit("Judge error")).otherwise(v["value"]["reasoning"])
    return samples.withColumns({"judge_score": F.when(chosen, score), "judge_reasoning": F.when(chosen, reason)})


def samples(found: DataFrame, docs: DataFrame, questions: DataFrame, generator, k: int = 5) -> DataFrame:
    """An evaluation run: found(query_id, rank, doc_id, score), docs(doc_id, text), questions(query_id, question, ...) to a sample for each question.

    The columns of questions, contexts, scores (both by rank; empty if nothing was found) and answer of ``generator``.
    """
    rows = found.where(F.col("rank") <= k).join(docs.select("doc_id", "text"), "doc_id")
    rows = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "score"))).alias("r"))
    out = questions.join(rows, "query_id", "left")
    out = out.withColumns({"contexts": F.coalesce(F.transform("r", lambda x: x["text"]), F.array().cast("array<string>")), "scores": F.coalesce(F.transform("r", lambda x: x["score"]), F.array().cast("array<double>"))}).drop("r")
    return out.withColumn("answer", generator(F.col("question"), F.col("contexts")))


def means(samples: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Plain means; what is null (not judged) doesn't count."""
    return samples.groupBy(*by).agg(*[F.round(F.avg(c), 6).alias(c) for c in columns])


def report(rows: list[dict]) -> str:
    """Markdown table of a few configurations; a row with ``error`` says so."""
    out = ["# Evaluation", "", "| Store | Mode | Reranked | k | Faithfulness | Answer relevance | Context precision | Context recall |", "|---|---|---|---|---|---|---|---|"]
    for r in rows:
        head = f"| {r.get('store', '-')} | {r.get('mode', 'dense')} | {'yes' if r.get('reranked') else 'no'} | {r.get('k', '-')} | "
        if "error" in r:
            out.append(head + f"error: {str(r['error'])[:30]} | | | |")
        else:
            out.append(head + " | ".join(f"{r.get(m, 0):.3f}" for m in ("faithfulness", "answer_relevance", "context_precision", "context_recall")) + " |")
    return "\n".join(out)


def run_grid(grid_rows: list[dict], run) -> list[dict]:
    """run(**row) gives metrics of one configuration; one that fails becomes a row with its error, and the others go on."""
    out = []
    for row in grid_rows:
        try:
            out.append(row | run(**row))
        except Exception as e:  # noqa: BLE001  an error row is the contract
            out.append(row | {"error": str(e)})
    return out
