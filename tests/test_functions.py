import math

import pytest
from pyspark.sql import functions as F

from sparquill.functions import numbers, text as tx, vectors as vx


def one(spark, column, *values, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_tokens(spark):
    assert one(spark, tx.tokens(F.col("v")), "A b, Größe-X 42!", "", None) == [["größe", "42"], [], []]


@pytest.mark.parametrize("raw,value", [("(30)", -30.0), ("$(30)", None), ("5%", 0.05), ("(5%)", -0.05), ("1,485", 1485.0), ("—", None), ("N/A", None), ("1_000", 1000.0), ("1e5", 1e5), ("", None), (None, None)])
def test_numeric(spark, raw, value):
    got = one(spark, numbers.numeric(F.col("v")), raw)[0]
    assert got == value or math.isclose(got, value)


def test_numeric_lenient_and_special(spark):
    assert one(spark, numbers.numeric(F.col("v"), lenient=True), "$(30)") == [-30.0]
    assert math.isnan(one(spark, numbers.numeric(F.col("v")), "nan")[0])
    assert one(spark, numbers.numeric(F.col("v")), "-inf") == [-math.inf]


def test_table_like_counts_bare_commas(spark):
    assert one(spark, tx.table_like(F.col("v")), "a, b, c", "a\tb\tc", "a  b  c", "plain text") == [True, True, True, False]


def test_sections(spark):
    assert one(spark, tx.section(F.col("v")), "Notes to the financial statements", "Auditor's Report", "nothing", "") == ["Financial Statements", "Auditor's Report", None, None]


def test_content_types(spark):
    table = "a 1 2\nb 3 4\nc 5 6\nd 7 8"
    mixed = "\n".join(["words here that go on and on"] * 3 + ["1 2"])
    assert one(spark, tx.content_type(F.col("v")), "OVERVIEW", table, mixed, "some longer text that isn't a header at all", "") == ["header", "table", "mixed", "text", "text"]


def test_headers(spark):
    assert one(spark, tx.headers(F.col("v")), "OVERVIEW\nsome text that goes on for a while here\nNet Income") == [["OVERVIEW", "Net Income"]]


def test_flags(spark):
    row = spark.createDataFrame([("Paid $1,200 on 12/31/2024, see Chart 2",)], "v string")
    assert row.select(tx.has_numbers(F.col("v")), tx.has_dates(F.col("v")), tx.has_figures(F.col("v")), tx.mentions_figure(F.col("v"))).first()[:] == (True, True, True, True)


def test_captions(spark):
    assert one(spark, tx.table_caption(F.col("v")), "x\nTable 3: Loans\ny", "none") == ["Table 3: Loans", None]
    assert one(spark, F.length(tx.figure_caption(F.col("v"))), "Figure 1 " + "x" * 400) == [303]


def test_decompose(spark):
    got = one(spark, tx.decompose(F.col("v")), "What was net income in 2024 and how did assets change?", "simple")
    assert [[p.sub_query for p in row] for row in got] == [["What was net income in 2024?", "how did assets change?"], ["simple"]]


def test_parse_listed(spark):
    row = spark.createDataFrame([("1. What is A? - Intent: a\n\n2) And B?\n3. C\n4. D",), ("SIMPLE: x",), ("no list",)], "v string")
    got = [[(p.hop, p.sub_query, p.intent) for p in r[0]] for r in row.select(tx.parse_listed(F.col("v"), F.lit("q"))).collect()]
    assert got[0] == [(0, "What is A?", "a"), (2, "And B?", "sub-query"), (3, "C", "sub-query")]
    assert got[1] == got[2] == [(0, "q", "original")]


def test_complexity(spark):
    assert one(spark, tx.is_complex(F.col("v")), "one two three four five six seven eight nine underst" + "and", "short and sweet", "a b c d e f g h i j? k?") == [True, False, True]


def test_boilerplate(spark):
    assert one(spark, tx.is_boilerplate(F.col("v")), "Contact information", "Image from page", "Image from page with a chart", "Bars of loans", "", None) == [True, True, False, False, False, False]


def test_snippet(spark):
    assert one(spark, tx.snippet(F.col("v"), 7), "short", "longer text") == ["short", "longer ..."]
    assert one(spark, tx.snippet(F.col("v"), 9, True), "longer text here") == ["longer..."]


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    got = row.select(vx.dot(a, b), vx.l2(a, b), vx.cosine(a, b), vx.cosine(a, z), vx.normalised(a), vx.similarity(F.lit(1.0)), vx.similarity(F.lit(-1.0))).first()
    assert got[0] == 24 and got[1] == 2 and math.isclose(got[2], 0.96) and got[3] == 0 and got[4] == [0.6, 0.8] and got[5] == 0.5 and got[6] == 0
    assert row.select(F.aggregate(vx.hashed_embedding(F.array(F.lit("a"), F.lit("b"))), F.lit(0.0), lambda s, x: s + x)).first()[0] == 2
