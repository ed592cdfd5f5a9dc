"""Chunks of texts: recursive by separators, or of a fixed stride."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

SIZE, OVERLAP = 1000, 150
SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """Parts that begin with the separator, but for the first."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in [first, *[separator + r for r in rest]] if p]


def _merged(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Full chunks of the pieces, each beginning with the end of the one before, as far as the overlap goes."""
    out, held, total = [], [], 0
    for piece in pieces:
        if held and total + len(piece) > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    return [c for c in [*out, "".join(held).strip()] if c]


def recursive(text: str | None, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    if not text:
        return []
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    out, short = [], []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            short.append(piece)
            continue
        out += _merged(short, size, overlap)
        short = []
        rest = separators[at + 1 :]
        out += recursive(piece, size, overlap, rest) if rest else [piece]
    return out + _merged(short, size, overlap)


def split_recursive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_index (from 0), text, n_chars."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap is smaller than the size")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(d, i, c, len(c)) for d, t in zip(pdf["doc_id"], pdf["text"]) for i, c in enumerate(recursive(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text", "n_chars"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, chunk_index long, text string, n_chars long")


def split_stride(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of ``size`` characters every ``size - overlap``, in built-in functions."""
    start = F.sequence(F.lit(1), F.greatest(F.length(text_col) - overlap, F.lit(1)), F.lit(size - overlap))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_col, F.posexplode(start).alias("i", "at"))
    chunk = F.substring(F.col(text_col), F.col("at"), F.lit(size))
    return rows.select("doc_id", F.col("i").cast("bigint").alias("chunk_index"), chunk.alias("text"), F.length(chunk).cast("bigint").alias("n_chars"))


def chunk_index(chunks: DataFrame, page: list[str], position: str) -> DataFrame:
    """Running number within the page, from 0."""
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy(*page).orderBy(position)).cast("bigint") - 1)


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    t = F.col("text")
    return chunks.withColumns({"content_type": tx.content_type(t), "word_count": tx.word_count(t), "has_numbers": tx.has_numbers(t), "has_dates": tx.has_dates(t)})
