"""Patches of pages: geometry, page scores, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked

AGGREGATIONS = ("max", "mean", "sum", "weighted")


def grid(pages: DataFrame, rows: int = 2, cols: int = 2, overlap: float = 0.1) -> DataFrame:
    """pages(doc_id, page, width, height) to one row for each patch, in pixels and shares of the page."""
    cells = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.struct(r.alias("row"), c.alias("col"))))))
    p = pages.withColumn("cell", cells).select("doc_id", "page", "width", "height", F.col("cell.row").cast("bigint").alias("row"), F.col("cell.col").cast("bigint").alias("col"))
    base = lambda side, n: F.floor(F.col(side) / n)
    p = p.withColumns({"bw": base("width", cols), "bh": base("height", rows)})
    p = p.withColumns({"px": F.col("col") * F.col("bw"), "py": F.col("row") * F.col("bh")})
    p = p.withColumns({"xe": F.least(F.col("px") + F.col("bw") + F.floor(F.col("bw") * overlap), F.col("width")), "ye": F.least(F.col("py") + F.col("bh") + F.floor(F.col("bh") * overlap), F.col("height"))})
    share = lambda a, b, name: F.round(a / b, 6).alias(name)
    name = F.format_string("p%03d_r%d_c%d", "page", "row", "col")
    return p.select("doc_id", "page", name.alias("patch_id"), "row", "col", F.col("px").alias("pixel_x"), F.col("py").alias("pixel_y"), (F.col("xe") - F.col("px")).alias("pixel_width"), (F.col("ye") - F.col("py")).alias("pixel_height"), share(F.col("px"), F.col("width"), "x"), share(F.col("py"), F.col("height"), "y"), share(F.col("xe") - F.col("px"), F.col("width"), "w"), share(F.col("ye") - F.col("py"), F.col("height"), "h"))


def page_scores(patches: DataFrame, aggregation: str = "max", top_patches: int = 3) -> DataFrame:
    """patches(query_id, doc_id, page, patch_id, score), the retrieved ones, to page scores. An unknown aggregation is max.

    num_relevant: patches of at least half the page's highest score, so none if that is negative.
    """
    page = ["query_id", "doc_id", "page"]
    p = ranked(patches, [F.desc("score"), F.col("patch_id")], page, "n").withColumn("most", F.max("score").over(Window.partitionBy(*page)))
    value = {"mean": F.avg("score"), "sum": F.sum("score"), "weighted": F.sum(F.col("score") / F.col("n"))}.get(aggregation, F.max("score"))
    return p.groupBy(*page).agg(
        F.round(value + 1e-12, 6).alias("score"),  # sums of halves round alike in any order
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.round(F.max("score"), 6).alias("max_score"),
        F.count_if((F.col("score") >= 0.5 * F.col("most"))).alias("num_relevant"),
        F.array_sort(F.collect_list(F.when(F.col("n") <= top_patches, F.struct("n", "patch_id", "score")))).alias("top_patches"),
    )


def colour(score: Column) -> Column:
    return F.when(score > 0.7, "green").when(score > 0.5, "yellow").when(score > 0.3, "orange").otherwise("red")


def attribution(pages: DataFrame, max_pages: int = 5, max_patches: int = 10) -> DataFrame:
    """Ranked pages with their top patches: query_id, page_rank, doc_id, page, patch_rank, patch_id, score, colour."""
    top = ranked(pages, [F.desc("score"), F.col("doc_id"), F.col("page")], name="page_rank").where(F.col("page_rank") <= max_pages)
    rows = top.select("query_id", "page_rank", "doc_id", "page", F.explode("top_patches").alias("t")).where(F.col("t.n") <= max_patches)
    return rows.select("query_id", "page_rank", "doc_id", "page", F.col("t.n").alias("patch_rank"), F.col("t.patch_id").alias("patch_id"), F.round("t.score", 6).alias("score"), colour(F.col("t.score")).alias("colour"))


def heat(patches: DataFrame, cols: int = 16, rows: int = 12) -> DataFrame:
    """Highest score of each grid cell, as a share of the page's highest: query_id, doc_id, page, cell_row (by y), cell_col (by x), heat."""
    cell = lambda v, n: F.least(F.floor(F.col(v) * n), F.lit(n - 1)).cast("bigint")
    cells = patches.withColumns({"cell_row": cell("y", rows), "cell_col": cell("x", cols)}).groupBy("query_id", "doc_id", "page", "cell_row", "cell_col").agg(F.max("score").alias("score"))
    most = F.max("score").over(Window.partitionBy("query_id", "doc_id", "page"))
    return cells.select("query_id", "doc_id", "page", "cell_row", "cell_col", F.round(F.when(most > 0, F.col("score") / most).otherwise(F.col("score")), 6).alias("heat"))


def thresholded(patches: DataFrame, least: float = 0.0) -> DataFrame:
    """The retrieved patches of a score of ``least`` or more."""
    return patches.where(F.col("score") >= least)


def contexts(pages: DataFrame, images: DataFrame, most: int = 3) -> DataFrame:
    """The first ``most`` pages, those without an image (doc_id, page) left out: query_id, page_rank, doc_id, page, confidence."""
    top = ranked(pages, [F.desc("score"), F.col("doc_id"), F.col("page")], name="page_rank").where(F.col("page_rank") <= most)
    return top.join(images.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi").select("query_id", "page_rank", "doc_id", "page", F.col("score").alias("confidence"))


def confidence(found: DataFrame) -> DataFrame:
    """Mean confidence of the contexts of each question: query_id, n_contexts, confidence."""
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_contexts"), F.round(F.avg("confidence") + 1e-12, 6).alias("confidence"))


NO_CONTEXT = "No relevant visual context was found."


def answers(questions: DataFrame, found: DataFrame, generator) -> DataFrame:
    """questions(query_id, question), found(query_id, page_rank, doc_id, page, confidence, top_patches) to query_id, answer, confidence, sources.

    ``generator`` answers from the question and array<struct<doc_id, page, confidence, n_patches>>; confidence is the mean of the
    contexts. A question without contexts gets NO_CONTEXT, 0 and no sources.
    """
    source = F.struct("doc_id", "page", "confidence", F.size("top_patches").cast("bigint").alias("n_patches"))
    listed = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_rank", source.alias("s")))), lambda x: x["s"]).alias("sources"), F.round(F.avg("confidence") + 1e-12, 6).alias("confidence"))
    rows = questions.join(listed, "query_id", "left")
    some = F.col("sources").isNotNull()
    answer = F.when(some, generator(F.col("question"), F.col("sources"))).otherwise(NO_CONTEXT)
    return rows.select("query_id", answer.alias("answer"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.when(some, F.col("sources")).otherwise(F.array()).alias("sources"))


def retrieve(patches: DataFrame, queries: DataFrame, top_pages: int = 5, top_patches: int = 50, aggregation: str = "max", least: float | None = None) -> DataFrame:
    """The whole of visual retrieval: patches(doc_id, page, patch_id, embedding), queries(query_id, vector) to ranked pages.

    query_id, page_rank, doc_id, page, score, num_relevant, top_patches, and how much was searched: n_patches, n_pages.
    ``least``: threshold of patches before pages are scored. Without patches there are no rows.
    """
    from . import dense

    found = dense.search(patches.select(F.col("patch_id").alias("vec_id"), "embedding"), queries, top_patches, "cosine").withColumnRenamed("vec_id", "patch_id")
    found = found.join(patches.select("patch_id", "doc_id", "page"), "patch_id")
    pages = page_scores(found if least is None else thresholded(found, least), aggregation)
    top = ranked(pages, [F.desc("score"), F.col("doc_id"), F.col("page")], name="page_rank").where(F.col("page_rank") <= top_pages)
    searched = patches.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_patches"), F.count(F.lit(1)).alias("n_pages"))
    return top.crossJoin(F.broadcast(searched)).select("query_id", "page_rank", "doc_id", "page", "score", "num_relevant", "top_patches", "n_patches", "n_pages")  # one row


def page_patches(patches: DataFrame, doc_id, page: int) -> DataFrame:
    return patches.where((F.col("doc_id") == doc_id) & (F.col("page") == page))


def patch(patches: DataFrame, patch_id) -> DataFrame:
    """The patch of an id: one row, or none."""
    return patches.where(F.col("patch_id") == patch_id).limit(1)


def embedded(patches: DataFrame, describe, embed, dims: int) -> DataFrame:
    """patches with embedding and failed: ``describe`` and ``embed`` are providers (a column to a column).

    What can't be described, or gets a vector of another length, has failed: its vector is zero, so it is near nothing.
    """
    rows = patches.withColumn("embedding", embed(describe).cast("array<double>")).withColumn("failed", describe.isNull())
    failed = F.col("failed") | F.coalesce(F.size("embedding") != dims, F.lit(True))
    return rows.withColumn("failed", failed).withColumn("embedding", F.when(F.col("failed"), F.array_repeat(F.lit(0.0), dims)).otherwise(F.col("embedding")))


def summary(query: str, pages: list[dict], searched: int) -> str:
    """Text of an attribution; pages: page, score, patches (x, y, score)."""
    if not pages:
        return "No relevant pages found."
    out = [f'Query: "{query}"', "", f"Found {len(pages)} relevant page(s) from {searched} patches.", ""]
    for p in pages:
        out += [f"**Page {p['page']}** (score: {p['score']:.3f})", f"  - {len(p['patches'])} relevant region(s)"]
        if p["patches"]:
            first = p["patches"][0]
            out.append(f"  - Top region: ({first['x']:.2f}, {first['y']:.2f}), score: {first['score']:.3f}")
        out.append("")
    return "\n".join(out)
