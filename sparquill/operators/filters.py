"""Metadata filters of ranked lists, after an over-fetch or before the ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ranked

OVERFETCH = 3


@dataclass(frozen=True)
class MetadataFilter:
    """None: no condition. An empty list rejects all."""

    page_start: int | None = None
    page_end: int | None = None
    sections: list[str] | None = None
    content_types: list[str] | None = None

    def condition(self) -> Column:
        """A missing page is 0 at the start and endless at the end; a missing section is "", a missing type "text"."""
        out = F.lit(True)
        if self.page_start is not None:
            out = out & (F.coalesce("page", F.lit(0)) >= self.page_start)
        if self.page_end is not None:
            out = out & (F.col("page").isNull() | (F.col("page") <= self.page_end))
        if self.sections is not None:
            out = out & F.coalesce("section", F.lit("")).isin(*self.sections) if self.sections else F.lit(False)
        if self.content_types is not None:
            out = out & F.coalesce("content_type", F.lit("text")).isin(*self.content_types) if self.content_types else F.lit(False)
        return out


def post_filter(lists: DataFrame, metadata: DataFrame, condition: Column, k: int, id_col: str = "doc_id") -> DataFrame:
    """lists holds OVERFETCH * k ranks for each query; those that meet the condition are ranked anew and cut to k. Fewer than k may be left."""
    kept = lists.where(F.col("rank") <= OVERFETCH * k).join(metadata, id_col).where(condition).withColumnRenamed("rank", "__old")
    return ranked(kept, [F.col("__old")]).where(F.col("rank") <= k).drop("__old")


def pre_filter(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows that may be ranked at all; the condition reaches the scan."""
    return rows.where(condition)
