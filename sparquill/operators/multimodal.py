"""Text, tables and images together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .ranking import ranked

# Words that ask for tables or images.
TABLE_WORDS = ["table", "row", "column", "cell", "value", "total", "sum", "percent", "percentage", "%", "fy", "fiscal", "quarter", "revenue", "income", "expense", "cost", "profit", "loss", "billion", "million", "thousand", "$", "usd", "eur", "increase", "decrease", "growth", "change", "difference", "compare", "comparison", "ratio", "margin", "rate"]
IMAGE_WORDS = ["chart", "graph", "figure", "diagram", "plot", "visualization", "trend", "line", "bar", "pie", "area", "scatter", "show", "display", "illustrate", "depict", "image", "picture", "climate", "sustainability", "environment", "investment", "investments", "net income", "income", "revenue", "fy22", "fy23", "fy24", "fy20", "over time", "across years", "historical"]


def intent(query: Column, table_words: list[str] | None = None, image_words: list[str] | None = None) -> Column:
    """struct<text_w,table_w,image_w>: weights of the modalities, summing to 1."""
    low = F.lower(query)
    t, i = tx.count_of(low, table_words or TABLE_WORDS), tx.count_of(low, image_words or IMAGE_WORDS)
    total = (t + i + 1).cast("double")
    table, image = 0.4 * t / total + 0.1, 0.4 * i / total + 0.1
    weight = 0.3 + table + image
    asked = F.struct((0.3 / weight).alias("text_w"), (table / weight).alias("table_w"), (image / weight).alias("image_w"))
    return F.when(t + i == 0, F.struct(F.lit(0.6).alias("text_w"), F.lit(0.25).alias("table_w"), F.lit(0.15).alias("image_w"))).otherwise(asked)


def order_images(images: DataFrame, most: int = 2) -> DataFrame:
    """images(query_id, query, rank, id, description), the fetched ones, to query_id, position, id, is_boilerplate.

    A question with a theme takes substantive images that mention it, or any substantive ones if none does; another takes
    substantive images first, then boilerplate.
    """
    rows = images.where(F.col("rank") <= min(most + 10, 20))
    theme = tx.theme_words(F.col("query"))
    rows = rows.withColumns({"is_boilerplate": tx.is_boilerplate(F.col("description")), "thematic": tx.contains_any(F.lower("query"), tx.THEME_TRIGGERS), "matches": (F.size(theme) == 0) | F.exists(theme, lambda t: F.contains(F.lower(F.coalesce("description", F.lit(""))), t))})
    found = F.coalesce(F.max(F.col("matches") & ~F.col("is_boilerplate")).over(Window.partitionBy("query_id")), F.lit(False))
    rows = rows.withColumn("found", found).where(~F.col("thematic") | (~F.col("is_boilerplate") & (F.col("matches") | ~F.col("found"))))
    return ranked(rows, [F.col("is_boilerplate"), F.col("rank")], name="position").where(F.col("position") <= most).select("query_id", "position", "id", "is_boilerplate")


def combine(text: DataFrame, tables: DataFrame, images: DataFrame, mode: str = "auto", caps: tuple[int, int, int] = (5, 3, 2)) -> DataFrame:
    """Ranked lists (query_id, rank, id) of the modalities that ``mode`` asks for. In mode auto all weights exceed the limit of 0.1, so it is mixed."""
    wanted = {"text": ("text",), "tables": ("table",), "images": ("image",)}.get(mode, ("text", "table", "image"))
    out = None
    for name, df, cap in zip(("text", "table", "image"), (text, tables, images), caps):
        if name in wanted:
            part = df.where(F.col("rank") <= cap).select("query_id", F.lit(name).alias("modality"), "rank", "id")
            out = part if out is None else out.unionByName(part)
    return out


def as_documents(items: DataFrame, modality: str) -> DataFrame:
    """Tables or figures to documents: modality, item_id, page, caption (empty, never null), text, and for figures chart_type (empty, never null).

    Tables have item_id, page, caption, text; figures also chart_type and description, which is their text.
    """
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    base = [F.lit(modality).alias("modality"), "item_id", "page", empty("caption")]
    if modality == "table":
        return items.select(*base, "text")
    return items.select(*base, F.col("description").alias("text"), empty("chart_type"))


def with_records(hits: DataFrame, records: DataFrame, key: str = "item_id") -> DataFrame:
    """hits with the whole record of each item; a hit without one keeps its row, with nulls."""
    return hits.join(records, key, "left")


def described(images: DataFrame, caption: Column, error: Column | None = None) -> DataFrame:
    """images(content binary, ...) with description and role, those without content left out.

    ``caption``: struct<description, role> of a provider, null where it failed; ``error`` says why.
    """
    failed = caption.isNull() | caption["description"].isNull()
    why = F.concat(F.lit("caption_failed: "), F.coalesce(error, F.lit("no answer")) if error is not None else F.lit("no answer"))
    rows = images.where(F.coalesce(F.octet_length("content"), F.lit(0)) > 0)
    return rows.withColumns({"description": F.when(failed, why).otherwise(caption["description"]), "role": F.when(failed, "unknown").otherwise(F.coalesce(caption["role"], F.lit("unknown")))})
