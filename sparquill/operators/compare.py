"""Two pipelines side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def page_sets(left: DataFrame, right: DataFrame, item: str = "doc_id") -> DataFrame:
    """Lists of query_id and an item to the sizes of overlap and differences, and the Jaccard share."""
    sets = lambda df, name: df.groupBy("query_id").agg(F.collect_set(item).alias(name))
    both = sets(left, "a").join(sets(right, "b"), "query_id", "full_outer")
    none = F.array().cast(both.schema["a"].dataType)
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    size = lambda c: F.size(c).cast("bigint")
    shared, all_ = size(F.array_intersect(a, b)), size(F.array_union(a, b))
    return both.select("query_id", size(a).alias("n_a"), size(b).alias("n_b"), shared.alias("overlap"), size(F.array_except(a, b)).alias("only_a"), size(F.array_except(b, a)).alias("only_b"), F.round(F.coalesce(F.try_divide(shared, all_), F.lit(0.0)), 6).alias("jaccard"))


def word_overlap(a: Column, b: Column) -> Column:
    """struct of lengths, common and single words and two shares, of lower-case words between white space."""
    x, y = F.array_distinct(tx.words(F.lower(a))), F.array_distinct(tx.words(F.lower(b)))
    size = lambda c: F.size(c).cast("bigint")
    common, union = size(F.array_intersect(x, y)), size(F.array_union(x, y))
    share = lambda n: F.round(common / F.greatest(n, F.lit(1)), 6)
    return F.struct(
        F.length(a).cast("bigint").alias("length_a"),
        F.length(b).cast("bigint").alias("length_b"),
        common.alias("common"),
        size(F.array_except(x, y)).alias("only_a"),
        size(F.array_except(y, x)).alias("only_b"),
        share(union).alias("jaccard"),
        share(F.greatest(size(x), size(y))).alias("overlap"),
    )


def speedup(a_ms: Column, b_ms: Column) -> Column:
    return F.round(a_ms / F.greatest(b_ms, F.lit(0.1)), 6)


def preferred(query: Column, overlap: Column, n_a: Column, n_b: Column, only_b: Column, similarity: Column, ms_a: Column, ms_b: Column, length_a: Column, length_b: Column) -> Column:
    """a (classic) or b (visual), by the first rule that holds."""
    return (
        F.when(tx.contains_any(F.lower(query), tx.VISUAL_WORDS), "b")
        .when((overlap < F.least(n_a, n_b) / 2) & (only_b > 0), "b")
        .when(similarity > 0.7, F.when(ms_a < ms_b, "a").otherwise("b"))
        .when(length_b > length_a * 1.5, "b")
        .otherwise("a")
    )
