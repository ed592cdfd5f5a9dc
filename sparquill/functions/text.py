"""Text functions: tokens, sections, content types, captions, query analysis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section patterns, in the order in which they are tried, and their labels.
SECTIONS = [
    (r"executive\s+summary", "Executive Summary"),
    (r"letter\s+(?:from|to)\s+(?:the\s+)?(?:president|ceo|chairman|shareholders)", "Letter to Stakeholders"),
    (r"message\s+from\s+(?:the\s+)?(?:president|ceo|chairman)", "Letter to Stakeholders"),
    (r"financial\s+highlights", "Financial Highlights"),
    (r"financial\s+statements?", "Financial Statements"),
    (r"consolidated\s+(?:financial\s+)?statements?", "Financial Statements"),
    (r"balance\s+sheet", "Balance Sheet"),
    (r"income\s+statement", "Income Statement"),
    (r"statement\s+of\s+(?:comprehensive\s+)?income", "Income Statement"),
    (r"cash\s+flow", "Cash Flow Statement"),
    (r"statement\s+of\s+cash\s+flows?", "Cash Flow Statement"),
    (r"statement\s+of\s+changes\s+in\s+equity", "Equity Statement"),
    (r"notes?\s+to\s+(?:the\s+)?(?:consolidated\s+)?financial\s+statements?", "Notes to Financial Statements"),
    (r"significant\s+accounting\s+policies", "Accounting Policies"),
    (r"critical\s+accounting\s+(?:policies|estimates)", "Accounting Policies"),
    (r"risk\s+management", "Risk Management"),
    (r"credit\s+risk", "Risk Management"),
    (r"market\s+risk", "Risk Management"),
    (r"liquidity\s+risk", "Risk Management"),
    (r"corporate\s+governance", "Corporate Governance"),
    (r"board\s+of\s+directors?", "Corporate Governance"),
    (r"management['']?s?\s+discussion", "Management Discussion"),
    (r"md&a|management\s+discussion\s+and\s+analysis", "Management Discussion"),
    (r"auditor['']?s?\s+report", "Auditor's Report"),
    (r"independent\s+auditor", "Auditor's Report"),
    (r"appendix|annex", "Appendix"),
    (r"glossary", "Glossary"),
    (r"table\s+of\s+contents", "Table of Contents"),
]
FIRST_SECTION = "Introduction"
NUMBERS = r"\$[\d,]+|\d+%|[\d,]+\.\d{2}|\b\d{1,3}(?:,\d{3})+\b"
DATES = r"(?i)\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},?\s+\d{4}\b|\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b|\b(?:fy|fiscal\s+year)\s*\d{2,4}\b"
FIGURES = r"figure\s+\d|chart|graph|illustration"
TABLE_CAPTIONS = [r"Table\s+\d+[:\.]?\s*([^\n]+)", r"TABLE\s+\d+[:\.]?\s*([^\n]+)", r"Exhibit\s+\d+[:\.]?\s*([^\n]+)"]
FIGURE_CAPTIONS = [r"Figure\s+\d+[:\.]?\s*([^\n]+)", r"FIGURE\s+\d+[:\.]?\s*([^\n]+)", r"Fig\.\s*\d+[:\.]?\s*([^\n]+)", r"Chart\s+\d+[:\.]?\s*([^\n]+)", r"Graph\s+\d+[:\.]?\s*([^\n]+)", r"Exhibit\s+\d+[:\.]?\s*([^\n]+)"]
FIGURE_MENTION = r"(?i)Figure\s+\d+|Fig\.\s*\d+|Chart\s+\d+|Graph\s+\d+|Exhibit\s+\d+"
COMPLEX_WORDS = ["and", "also", "both", "compare", "difference between", "relationship between", "how does", "what are the", "multiple", "several", "various", "as well as", "in addition", "furthermore", "moreover"]
BOILERPLATE = ["[BOILERPLATE", "contact information", "contact details", "auditor", "deloitte", "touche", "tel:", "fax:", "tel ", "fax ", "www.", ".com", "suite ", "place", "mclean", "address", "independent auditors", "legal disclaimer", "signatures of", "signature", "executive", "president", "managing director", "names and titles", "key executives"]
GENERIC = ["image from financial report", "image from page"]
SUBSTANTIVE = ["chart", "graph", "trend", "data", "axis", "value", "percent", "growth", "comparison", "distribution", "climate", "investment", "sustainability"]
THEME_TRIGGERS = ["climate", "sustainability", "investment", "investments", "environment", "green"]
THEMES = ["climate", "sustainability", "investment", "environment", "green", "paris agreement", "finance"]
VISUAL_WORDS = ["chart", "graph", "figure", "table", "diagram", "image", "visual", "show", "display", "illustration", "picture"]


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of two characters or more; null gives none."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "))
    return F.filter(F.split(plain, r"\s+"), lambda x: F.length(x) > 1)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Parts between white space; none of a blank text."""
    return F.filter(F.split(stripped(text), r"\s+"), lambda x: x != "")


def contains_any(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def count_of(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases occur."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text, p))).cast("bigint")


def section(text: Column) -> Column:
    """Label of the first pattern that the first 500 characters hold; else null."""
    head = F.substring(F.lower(text), 1, 500)
    return F.coalesce(*[F.when(head.rlike(p), F.lit(label)) for p, label in SECTIONS])


def table_like(line: Column) -> Column:
    spread = line.contains("\t") | line.contains("  ")
    return (F.regexp_count(line, F.lit(r"[\d,]+\.?\d*")) >= 2) | (spread & (F.size(F.split(stripped(line), r"\t|\s{2,}")) >= 3))


def is_upper(text: Column) -> Column:
    """All cased characters are capitals, and there is one."""
    return (F.upper(text) == text) & (F.lower(text) != text)


def header_like(text: Column) -> Column:
    """Capitals of less than 100 characters, or at most six words of which over 70 % begin with a capital; an empty text isn't."""
    t, w = stripped(text), words(text)
    initials = F.size(F.filter(w, lambda x: is_upper(F.substring(x, 1, 1))))
    return (is_upper(t) & (F.length(t) < 100)) | ((F.size(w) <= 6) & (F.size(w) > 0) & (initials / F.greatest(F.size(w), F.lit(1)) > 0.7))


def content_type(text: Column) -> Column:
    """header, table, mixed or text."""
    lines = F.split(stripped(text), "\n")
    n = F.size(lines)
    ratio = F.size(F.filter(lines, table_like)) / n
    mean = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)) / n
    return F.when((n <= 3) & (mean < 100) & (is_upper(stripped(text)) | header_like(text)), "header").when((ratio > 0.5) & (n > 3), "table").when(ratio > 0.2, "mixed").otherwise("text")


def headers(text: Column) -> Column:
    """Header-like lines among the first 20, five at most."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 20), stripped)
    return F.slice(F.filter(lines, lambda x: (x != "") & (F.length(x) < 100) & header_like(x)), 1, 5)


def has_figures(text: Column) -> Column:
    return F.lower(text).rlike(FIGURES)


def has_numbers(text: Column) -> Column:
    return text.rlike(NUMBERS)


def has_dates(text: Column) -> Column:
    return text.rlike(DATES)


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def line_count(text: Column) -> Column:
    return F.size(F.split(stripped(text), "\n")).cast("bigint")


def caption(text: Column, patterns: list[str], limit: int) -> Column:
    """First match in the order of the patterns, cut to ``limit`` characters; else null."""
    found = F.coalesce(*[F.when(text.rlike(p), stripped(F.regexp_extract(text, p, 0))) for p in patterns])
    return F.when(F.length(found) > limit, F.concat(F.substring(found, 1, limit), F.lit("..."))).otherwise(found)


def table_caption(text: Column) -> Column:
    return caption(text, TABLE_CAPTIONS, 200)


def figure_caption(text: Column) -> Column:
    return caption(text, FIGURE_CAPTIONS, 300)


def mentions_figure(text: Column) -> Column:
    return F.coalesce(text.rlike(FIGURE_MENTION), F.lit(False))


def is_complex(query: Column, least_words: int = 10) -> Column:
    """A question of several parts: long enough, and with an indicator word, two question marks or an enumeration."""
    marks = F.length(query) - F.length(F.replace(query, F.lit("?"), F.lit("")))
    return (word_count(query) >= least_words) & (contains_any(F.lower(query), COMPLEX_WORDS) | (marks > 1) | query.rlike(r"\d+\.\s|\d+\)"))


def decompose(query: Column, most: int = 3) -> Column:
    """Sub-questions array<struct<hop,sub_query,intent>>, by conjunctions and sentence ends."""
    parts = F.filter(F.transform(F.split(query, r"(?i)\s+and\s+|\s+also\s+|,\s*and\s+|\.\s+"), stripped), lambda p: F.length(p) > 10)
    asked = F.transform(F.slice(parts, 1, most), lambda p, i: F.struct(i.cast("bigint").alias("hop"), F.when(p.endswith("?"), p).otherwise(F.concat(F.regexp_replace(p, r"\.+$", ""), F.lit("?"))).alias("sub_query"), F.concat(F.lit("part "), (i + 1).cast("string")).alias("intent")))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("hop"), query.alias("sub_query"), F.lit("original").alias("intent")))
    return F.when(F.size(parts) > 1, asked).otherwise(whole)


def parse_listed(response: Column, query: Column, most: int = 3) -> Column:
    """Sub-questions of a model's numbered answer, ``most`` at most; the question itself if it says SIMPLE or lists none."""
    pattern = r"^\d+[\.\)]\s*(.+?)(?:\s*-\s*Intent:\s*(.+))?$"
    lines = F.transform(F.split(stripped(response), "\n"), lambda x, i: F.struct(stripped(x).alias("line"), i.alias("i")))
    found = F.transform(
        F.filter(lines, lambda x: x["line"].rlike(pattern)),
        lambda x: F.struct(
            x["i"].cast("bigint").alias("hop"),
            stripped(F.regexp_extract(x["line"], pattern, 1)).alias("sub_query"),
            F.when(F.regexp_extract(x["line"], pattern, 2) != "", stripped(F.regexp_extract(x["line"], pattern, 2))).otherwise(F.lit("sub-query")).alias("intent"),
        ),
    )
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("hop"), query.alias("sub_query"), F.lit("original").alias("intent")))
    return F.when(stripped(response).startswith("SIMPLE:") | (F.size(found) == 0), whole).otherwise(F.slice(found, 1, most))


def is_boilerplate(description: Column) -> Column:
    low = F.lower(F.coalesce(description, F.lit("")))
    generic = (F.length(description) < 150) & contains_any(low, GENERIC) & ~contains_any(low, SUBSTANTIVE)
    return (low != "") & (contains_any(low, [p.lower() for p in BOILERPLATE]) | F.coalesce(generic, F.lit(False)))


def is_chart_size(width: Column, height: Column, least: int = 80) -> Column:
    return (width >= least) & (height >= least) & F.coalesce(F.try_divide(width, height).between(0.15, 6), F.lit(False))


def theme_words(query: Column) -> Column:
    """Theme words of a question that asks for a theme at all."""
    low = F.lower(query)
    asked = F.filter(F.array(*[F.lit(t) for t in THEMES]), lambda t: F.contains(low, t))
    return F.when(contains_any(low, THEME_TRIGGERS), asked).otherwise(F.array().cast("array<string>"))


def description_of(page: Column, figure_id: Column, content: Column, caption_: Column, description: Column, topics: Column, chart_type: Column, x_axis: Column, y_axis: Column, trend: Column) -> Column:
    """Lines that describe a figure for retrieval; what is missing gives no line."""
    line = lambda label, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(label), v))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("[FIGURE] Page "), page.cast("string"), F.lit(", "), figure_id),
        F.when(F.lower(content) == "boilerplate", "[BOILERPLATE: contact/logo/footer - not substantive content.]"),
        line("Caption: ", caption_),
        F.coalesce(description, F.lit("")),
        F.when(F.size(F.coalesce(topics, F.array().cast("array<string>"))) > 0, F.concat(F.lit("Topics: "), F.array_join(topics, ", "))),
        F.when(chart_type != "unknown", line("Chart type: ", chart_type)),
        line("X-axis: ", x_axis),
        line("Y-axis: ", y_axis),
        line("Trend: ", trend),
    )


def snippet(text: Column, limit: int, at_word: bool = False) -> Column:
    """The first ``limit`` characters, with dots if that is less than all; optionally back to the last blank."""
    cut = F.substring(text, 1, limit)
    if at_word:
        cut = F.when(F.instr(cut, " ") > 0, F.regexp_replace(cut, r"\s\S*$", "")).otherwise(cut)
    return F.when(F.length(text) > limit, F.concat(cut, F.lit("..."))).otherwise(text)
