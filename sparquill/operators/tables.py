"""Tables: text and structured forms, and the scan of tables in HTML or piped text."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import numeric


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))


def _after_first(rows: Column) -> Column:
    return F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))


def markdown(page: Column, table_id: Column, caption: Column, rows: Column, has_headers: bool = True) -> Column:
    """Text form: a title, the caption if any, the header row as it is, data rows padded to the widest row."""
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    padded = lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))
    head = F.get(rows, F.lit(0))
    body = F.transform(_after_first(rows) if has_headers else rows, lambda r: _line(padded(r)))
    lines = [
        F.array(F.concat(F.lit("[TABLE] Page "), page.cast("string"), F.lit(", "), table_id)),
        F.when(F.coalesce(caption, F.lit("")) != "", F.array(F.concat(F.lit("Caption: "), caption))).otherwise(F.array().cast("array<string>")),
    ]
    if has_headers:
        rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), F.size(head)), "|"), F.lit("|"))
        lines.append(F.when(F.size(rows) > 0, F.array(_line(head), rule)).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.concat(*lines, body), "\n")


def structured(rows: Column) -> Column:
    """struct<headers, rows: array<map>, normalized: array<map>, row_count, col_count>: the first row names the cells.

    A blank name is col_i, cells beyond the names are dropped, of equal names the last cell counts.
    """
    head = F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>"))
    names = F.transform(head, lambda h, i: F.when(F.trim(F.coalesce(h, F.lit(""))) == "", F.concat(F.lit("col_"), i.cast("string"))).otherwise(F.trim(h)))
    body = _after_first(rows)

    def as_map(row: Column, value) -> Column:
        n = F.least(F.size(row), F.size(names))
        last = F.filter(F.transform(F.slice(row, F.lit(1), n), lambda c, i: F.struct(F.get(names, i).alias("key"), value(c).alias("value"), i.alias("i"))), lambda e: ~F.exists(F.slice(names, e["i"] + 2, F.greatest(n - e["i"] - 1, F.lit(0))), lambda later: later == e["key"]))
        return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))

    return F.struct(
        F.transform(head, lambda h: F.trim(F.coalesce(h, F.lit("")))).alias("headers"),
        F.transform(body, lambda r: as_map(r, lambda c: F.trim(F.coalesce(c, F.lit(""))))).alias("rows"),
        F.transform(body, lambda r: as_map(r, numeric)).alias("normalized"),
        F.size(body).cast("bigint").alias("row_count"),
        F.size(head).cast("bigint").alias("col_count"),
    )


def shape(rows: Column) -> Column:
    return F.struct(F.size(rows).cast("bigint").alias("row_count"), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)).cast("bigint").alias("col_count"))


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.open = 0
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open += 1
            self.tables.append([])
        elif self.open and tag == "tr":
            self.tables[-1].append([])
        elif self.open and tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open -= 1
        elif tag in ("td", "th") and self.cell is not None:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_tables(html: str | None) -> list[list[list[str]]]:
    parser = _Tables()
    parser.feed(html or "")
    return [t for t in parser.tables if t]


def text_tables(text: str | None) -> list[list[list[str]]]:
    """Runs of two lines or more with two "|" or tabs or more each."""
    found, run = [], []
    for line in [*(text or "").split("\n"), ""]:
        cut = "|" if line.count("|") >= 2 else "\t" if line.count("\t") >= 2 else None
        if cut:
            run.append([c.strip() for c in line.strip().strip("|").split(cut)])
            continue
        if len(run) >= 2:
            found.append([r for r in run if not all(set(c) <= set("-: ") for c in r)])
        run = []
    return found


def scan(pages: DataFrame, id_col: str, text_col: str, method: str = "auto") -> DataFrame:
    """One row for each table: id, table_id, rows array<array<string>>. ``auto``: text tables only if a page has none in HTML."""
    if method not in ("html", "text", "auto"):
        raise ValueError(f"unknown method {method!r}")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for key, body in zip(pdf["key"], pdf["body"]):
                found = html_tables(body) if method in ("html", "auto") else []
                if not found and method in ("text", "auto"):
                    found = text_tables(body)
                out += [(key, f"table_{n:03d}", rows) for n, rows in enumerate(found, 1)]
            yield pd.DataFrame(out, columns=["id", "table_id", "rows"])

    return pages.select(F.col(id_col).alias("key"), F.col(text_col).alias("body")).mapInPandas(run, "id long, table_id string, rows array<array<string>>")
