"""Prompts as string columns, and providers of models with offline stand-ins."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


class Generator(Protocol):
    """Answers for a column of prompts; wrap a remote model in a pandas UDF that sends batches."""

    def __call__(self, question: Column, contexts: Column) -> Column: ...


def extractive(question: Column, contexts: Column, limit: int = 300) -> Column:
    """Stand-in for a generator: the beginning of the first context."""
    return tx.snippet(F.coalesce(F.get(contexts, F.lit(0)), F.lit("")), limit)


def gathered(lists: DataFrame, body: Column, k: int) -> DataFrame:
    """query_id and contexts: the bodies of the first k ranks, in their order."""
    top = lists.where(F.col("rank") <= k).select("query_id", F.struct("rank", body.alias("body")).alias("s"))
    return top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["body"]).alias("contexts"))


def page_body() -> Column:
    """A page label and the text."""
    return F.concat(F.lit("[page "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit("] "), F.col("text"))


def answer_prompt(question: Column, contexts: Column) -> Column:
    return F.concat(F.lit("Answer from the context only; if it does not hold the answer, say so.\n\nQuestion: "), question, F.lit("\n\nContext:\n"), F.array_join(contexts, "\n\n"), F.lit("\n\nAnswer:"))


def multimodal_prompt(question: Column, texts: Column, tables: Column, images: Column) -> Column:
    """Sections of those modalities that have contexts, with a rule between them."""
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(title + ":\n"), F.array_join(c, "\n\n")))
    body = F.concat_ws("\n\n" + "=" * 50 + "\n\n", part("TEXT EXCERPTS", texts), part("TABLES", tables), part("FIGURES", images))
    return F.when(body == "", F.concat(F.lit("Question: "), question, F.lit("\n\nNo relevant context was found."))).otherwise(F.concat(F.lit("CONTEXT:\n"), body, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:")))


def item_body(kind: str) -> Column:
    """A table (kind Table) or figure (kind Figure) under a head of its id and page, its type and caption if it has any; columns item_id, page, chart_type, caption, text."""
    some = lambda before, c, after="": F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(before), F.col(c), F.lit(after))).otherwise("")
    head = [F.lit(f"[{kind}: "), F.coalesce("item_id", F.lit("unknown")), F.lit(", Page "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit("]")]
    return F.concat(*head, some(" (Type: ", "chart_type", ")"), some("\nCaption: ", "caption"), F.lit("\n"), F.col("text"))


def item_prompt(kind: str, question: Column, bodies: Column) -> Column:
    """A question about tables or figures (``kind``: Table, Figure); one without any says so."""
    many = kind.lower() + "s"
    body = F.concat(F.lit(f"Answer from these {many} only. Name the {kind.lower()}, its page and the values used; if they do not hold the answer, say so.\n\n{many.upper()}:\n"), F.array_join(bodies, "\n\n---\n\n"), F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))
    none = F.concat(F.lit("Question: "), question, F.lit(f"\n\nNo {many} were retrieved.\n\nAnswer: I cannot answer this question, as no {many} were found."))
    return F.when(F.size(F.coalesce(bodies, F.array().cast("array<string>"))) > 0, body).otherwise(none)


def two_digits(value: Column) -> Column:
    return F.format_string("%.2f", value)


def page_prompt(question: Column, pages: Column) -> Column:
    """A question about page images; pages: array<struct<page, confidence, patches: array<struct<x, y, score>>>>, at most three patches of each are named."""

    def region(p: Column) -> Column:
        return F.concat(F.lit("\n  - Region at ("), two_digits(p["x"]), F.lit(", "), two_digits(p["y"]), F.lit("), score: "), two_digits(p["score"]))

    def shown(c: Column) -> Column:
        n = F.size(c["patches"])
        parts = F.concat(F.lit("\n  - "), n.cast("string"), F.lit(" relevant region(s) identified"), F.array_join(F.transform(F.slice(c["patches"], 1, 3), region), ""))
        return F.concat(F.lit("\nPage "), c["page"].cast("string"), F.lit(" (confidence: "), two_digits(c["confidence"]), F.lit("):"), F.when(n > 0, parts).otherwise(""))

    head = F.concat(F.lit("QUERY: "), question, F.lit("\n\n"), F.size(pages).cast("string"), F.lit(" page image(s) follow, with their most relevant regions. Answer from them, cite page and place, or say NOT FOUND IN VISUAL CONTEXT.\n\nRELEVANT PAGES:\n"))
    return F.concat(head, F.array_join(F.transform(pages, shown), ""))


def as_json(lists: DataFrame, columns: list[str]) -> DataFrame:
    """query_id and its ranked rows as one JSON array."""
    rows = F.array_sort(F.collect_list(F.struct("rank", F.struct(*columns).alias("row"))))
    return lists.groupBy("query_id").agg(F.to_json(F.transform(rows, lambda r: r["row"])).alias("result"))


def parsed(body: Column, schema: str) -> Column:
    """struct<value, failed>: a model's JSON answer; what doesn't parse, or is missing, has failed."""
    value = F.from_json(body, schema + ", __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    failed = body.isNull() | value["__bad"].isNotNull()
    return F.struct(F.when(~failed, value).alias("value"), failed.alias("failed"))


def structured(first: Column, second: Column, schema: str) -> Column:
    """struct<value, origin>: the first answer if it parses, else the second, else null; origin: first, second or error."""
    x, y = parsed(first, schema), parsed(second, schema)
    value = F.when(~x["failed"], x["value"]).when(~y["failed"], y["value"])
    return F.struct(value.alias("value"), F.when(~x["failed"], "first").when(~y["failed"], "second").otherwise("error").alias("origin"))


def first_existing(*paths: Column) -> Column:
    """The first path that is there, of a fixed order of names."""
    return F.coalesce(*[F.when(p != "", p) for p in paths])
