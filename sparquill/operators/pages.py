"""Pages: documents, metadata, sections, plain text of HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def numbered(docs: DataFrame, source: str = "source", order: str = "doc_id") -> DataFrame:
    """page: running number within a source."""
    return docs.withColumn("page", F.row_number().over(Window.partitionBy(source).orderBy(order)).cast("bigint"))


def sections(pages: DataFrame, source: list[str] = ["source"], page: str = "page", text: str = "text") -> DataFrame:
    """section: that of the page, else that of the page before; Introduction at the start."""
    order = Window.partitionBy(*source).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("section", F.coalesce(F.last(tx.section(F.col(text)), ignorenulls=True).over(order), F.lit(tx.FIRST_SECTION)))


def metadata(pages: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    kind = tx.content_type(t)
    return pages.withColumns({"content_type": kind, "has_tables": kind.isin("table", "mixed"), "has_figures": tx.has_figures(t), "word_count": tx.word_count(t), "line_count": tx.line_count(t)})


def documents(pages: DataFrame, about: DataFrame, text: str = "text") -> DataFrame:
    """Pages that are not blank, with what is known of them; a page without a number is page 1, without a section Unknown."""
    kept = pages.where(F.length(tx.stripped(F.col(text))) > 0).withColumn("page", F.coalesce("page", F.lit(1).cast("bigint")))
    return kept.join(about, "page", "left").withColumn("section", F.coalesce("section", F.lit("Unknown")))


def without_figures(pages: DataFrame, figures: DataFrame) -> DataFrame:
    """Pages that mention a figure but have none embedded."""
    return pages.where(tx.mentions_figure(F.col("text"))).join(figures.select("page").distinct(), "page", "left_anti")


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go with what they hold, other tags leave a blank."""
    out = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
