"""Pages, evaluation sets, indexes and samples as files."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "page int, text string, width double, height double"
QUESTIONS = "question string, ground_truth_context string, ground_truth_answer string, page_number string, content_type string"
PATCHES = "doc_id string, page bigint, patch_id string, embedding array<float>, x double, y double, width double, height double"
CACHE = "query string, query_embedding array<float>, answer string, retrieved_contexts array<string>, ts timestamp, metadata map<string,string>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).json(path)


def write_pages(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Five columns in their order, trimmed; pages: the numbers of page_number."""
    raw = spark.read.schema(QUESTIONS).csv(path, header=True, quote='"', escape='"', multiLine=True)
    trimmed = raw.select(*[F.trim(c).alias(c) for c in raw.columns])
    return trimmed.withColumn("pages", F.transform(F.filter(F.split("page_number", r"\s*;\s*"), lambda p: p.rlike(r"^\d+$")), lambda p: p.cast("bigint")))


def exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table, or an empty one where there is none."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_manifest(spark: SparkSession, path: str, folder: str, schema: str, file_col: str = "file_name") -> DataFrame:
    """Rows of a JSON manifest whose file is in the folder; none where there is no manifest."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).json(path)
    if not exists(spark, folder):
        return rows.limit(0)
    there = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias(file_col))
    return rows.join(there, file_col, "left_semi")


def load_dense(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """A dense store, vectors with the documents they stand for; ``kind``: parquet or json. An unknown kind is a ValueError, a missing store a FileNotFoundError."""
    if kind not in ("parquet", "json"):
        raise ValueError(f"unknown vector store: {kind}")
    if not exists(spark, path):
        raise FileNotFoundError(f"vector store not found: {path}")
    return spark.read.format(kind).load(path)


def write_dense(docs: DataFrame, vectors: DataFrame, path: str) -> None:
    """docs(doc_id, ...) with their embeddings, vectors(vec_id = doc_id, embedding), as one store."""
    docs.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").write.mode("overwrite").parquet(path)


def load_retriever(spark: SparkSession, kind: str, path: str, sparse_path: str | None = None):
    """A retriever over a stored dense side, and over a BM25 index too if it is there."""
    from ..operators import bm25
    from ..plans.retriever import Retriever

    rows = load_dense(spark, kind, path)
    index = bm25.load(spark, sparse_path) if sparse_path is not None and exists(spark, sparse_path) else None
    return Retriever(rows.drop("embedding"), rows.select(F.col("doc_id").alias("vec_id"), "embedding"), index)


def write_modalities(rows: DataFrame, path: str) -> None:
    """One table, in a folder for each modality."""
    rows.write.mode("overwrite").partitionBy("modality").parquet(path)


def read_modality(spark: SparkSession, path: str, modality: str) -> DataFrame | None:
    """The rows of a modality; none where there is no index."""
    return spark.read.parquet(path).where(F.col("modality") == modality) if exists(spark, path) else None


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors with unit-length copies, so that products are cosines."""
    from ..functions.vectors import normalised

    vectors.withColumn("unit", normalised(F.col("embedding"))).write.mode("overwrite").parquet(path)


def write_samples(samples: DataFrame, path: str) -> None:
    samples.write.mode("append").partitionBy("config").json(path)


def sample_name(store: str, k: int, mode: str = "dense", reranked: bool = False, at: datetime | None = None) -> str:
    """Name of a run: store, k, the mode unless it is dense, whether reranked, and when."""
    return f"eval_samples_{store}_k{k}{'' if mode == 'dense' else '_' + mode}{'_reranked' if reranked else ''}_{(at or datetime.now()):%Y%m%d_%H%M%S}"


def write_summary(spark: SparkSession, runs: list[dict], path: str) -> None:
    """A few runs as JSON rows of config, metrics and mean judge score; their samples are left out."""
    rows = [(json.dumps(r.get("config", {}), sort_keys=True), json.dumps(r.get("aggregated_metrics", {}), sort_keys=True), r.get("judge_avg_score")) for r in runs]
    out = spark.createDataFrame(rows, "config string, aggregated_metrics string, judge_avg_score double").coalesce(1)
    as_map = lambda c: F.from_json(c, "map<string,string>").alias(c)
    out.select(as_map("config"), as_map("aggregated_metrics"), "judge_avg_score").write.mode("overwrite").json(path)


def extract_all(pages: DataFrame, folder: str, skip_images: bool = False, skip_tables: bool = False, about: dict | None = None) -> dict[str, int]:
    """Pages (page, text, and html and images if there are any) to the files metadata, pages, tables and figures of a folder; how many of each.

    images: array<struct<figure_id, description>>. What is skipped counts 0 and leaves no file.
    """
    from ..operators import tables

    spark = pages.sparkSession
    spark.createDataFrame([(json.dumps(about or {}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")
    write_pages(pages.select(*[c for c in ("page", "text", "width", "height") if c in pages.columns]), f"{folder}/pages")
    counts = {"text_pages": read_pages(spark, f"{folder}/pages").count(), "images": 0, "tables": 0}
    if not skip_images and "images" in pages.columns:
        figures = pages.select("page", F.explode("images").alias("i")).select("page", "i.*")
        figures.write.mode("overwrite").parquet(f"{folder}/figures")
        counts["images"] = spark.read.parquet(f"{folder}/figures").count()
    if not skip_tables and "html" in pages.columns:
        tables.scan(pages.select("page", "html"), "page", "html").write.mode("overwrite").parquet(f"{folder}/tables")
        counts["tables"] = spark.read.parquet(f"{folder}/tables").count()
    return counts


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """Pages of PDF files: page, text, width, height and path. Needs a PDF library on the executors; without one it raises ImportError on the driver."""
    import fitz  # noqa: F401

    def run(batches):
        import fitz
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"]):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    rows += [(name, i, p.get_text(), p.rect.width, p.rect.height) for i, p in enumerate(doc, 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "text", "width", "height"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, " + PAGES)
