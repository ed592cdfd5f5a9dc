import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from sparquill.operators import bm25, cache, chunking, compare, dense, evaluate, filters, fusion, multimodal, pages, prompts, rerank, tables, visual
from sparquill.plans import config as cf
from sparquill.plans.retriever import Retriever


def lists(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, doc_id bigint, text string, rank bigint, score double")


def test_rrf_literal(spark):
    d = lists(spark, [(1, 1, "A", 1, 0.9), (1, 2, "B", 2, 0.8)])
    s = lists(spark, [(1, 2, "B", 1, 7.0), (1, 3, "C", 2, 6.0)])
    got = {r.doc_id: r for r in fusion.fuse(d, s).collect()}
    assert [got[i].rrf for i in (2, 1, 3)] == [round(0.7 / 62 + 0.3 / 61, 6), round(0.7 / 61, 6), round(0.3 / 62, 6)]
    assert (got[2].rank, got[2].dense_rank, got[2].sparse_rank, got[3].dense_rank) == (1, 2, 1, None)


def test_rrf_repeated_text_sums_and_shows_the_last(spark):
    d = lists(spark, [(1, 1, "A", 1, 0.9), (1, 2, "A", 3, 0.7)])
    s = lists(spark, [])
    row = fusion.fuse(d, s).first()
    assert (row.rrf, row.dense_rank, row.doc_id) == (round(0.7 / 61 + 0.7 / 63, 6), 3, 2)


def test_rrf_weights():
    with pytest.raises(ValueError):
        fusion.shares([1, 2, 3])
    with pytest.raises(ValueError):
        fusion.shares([0, 0])


def docs(spark):
    return spark.createDataFrame([(1, "red apple pie", 1, "a"), (2, "green apple", 2, None), (3, "", None, "b"), (4, "blue sky red red", 4, "a")], "doc_id bigint, text string, page bigint, section string")


def queries(spark, *texts):
    return spark.createDataFrame([(i, t, [1.0, 0.0]) for i, t in enumerate(texts)], "query_id bigint, text string, vector array<double>")


def test_bm25_counts_repeated_query_terms(spark):
    ix = bm25.build(docs(spark))
    one, two = bm25.score(ix, queries(spark, "apple")), bm25.score(ix, queries(spark, "apple apple"))
    a, b = ({r.doc_id: r.score for r in x.collect()} for x in (one, two))
    assert set(a) == {1, 2} and all(abs(b[k] - 2 * a[k]) < 1e-12 for k in a)
    assert bm25.search(ix, queries(spark, "", "zzz")).count() == 0
    n, avgdl = ix.stats.select("n", "avgdl").first()
    assert (n, avgdl) == (4, 9 / 4)


def test_bm25_saved_parameters_are_used(spark, tmp_path):
    ix = bm25.build(docs(spark), k1=0.5, b=0.1)
    bm25.save(ix, str(tmp_path / "ix"))
    again = bm25.load(spark, str(tmp_path / "ix"))
    q = queries(spark, "red apple")
    key = lambda x: sorted((r.doc_id, round(r.score, 9)) for r in bm25.score(x, q).collect())
    assert key(again) == key(ix) != key(bm25.build(docs(spark)))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 6))
def test_bm25_grows_with_term_frequency(spark, n):
    d = spark.createDataFrame([(i, " ".join(["word"] * i + ["other"] * (8 - i))) for i in (n, n + 1)] + [(99, "none")], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in bm25.score(bm25.build(d), queries(spark, "word")).collect()}
    assert got[n + 1] > got[n]


def test_dense_metrics_and_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None)], "vec_id bigint, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id bigint, vector array<float>")
    got = [(r.rank, r.vec_id, r.score) for r in dense.search(v, q, 2, "cosine").orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (2, 3, 1.0)]
    assert dense.search(v, q, 9, "l2").count() == 3
    with pytest.raises(Exception, match="unknown metric"):
        dense.search(v, q, 1, "x").collect()


def test_dense_blocks_of_queries(spark, monkeypatch):
    v = spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    whole = sorted(map(tuple, dense.search(v, q, 3).collect()))
    monkeypatch.setattr(dense, "BLOCK", 7)
    assert sorted(map(tuple, dense.search(v, q, 3).collect())) == whole


def test_filter_defaults(spark):
    rows = docs(spark).withColumn("content_type", F.lit(None).cast("string"))
    keep = lambda **c: sorted(r.doc_id for r in rows.where(filters.MetadataFilter(**c).condition()).collect())
    assert keep(page_start=2) == [2, 4] and keep(page_end=2) == [1, 2, 3]
    assert keep(sections=["a"]) == [1, 4] and keep(sections=[]) == [] and keep(content_types=["text"]) == [1, 2, 3, 4] and keep() == [1, 2, 3, 4]


def test_retriever_modes(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (9, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    r = Retriever(docs(spark), v, bm25.build(docs(spark)))
    q = queries(spark, "apple pie")
    first = lambda c: [x.doc_id for x in r.retrieve(q, c).orderBy("rank").collect()]
    assert first(cf.BASELINE) == [1, 2] and first(cf.RetrievalConfig(mode="sparse")) == [1, 2] and first(cf.HYBRID)[0] == 1
    assert first(cf.HYBRID_RERANKED)[0] == 1
    assert first(cf.RetrievalConfig(mode="sparse").with_metadata_filter(page_start=2)) == [2]
    assert first(cf.RetrievalConfig(mode="sparse", filter_mode="pre").with_metadata_filter(page_start=2)) == [2]
    assert [x.text for x in r.documents(q).orderBy("position").collect()] == ["red apple pie", "green apple"]
    with pytest.raises(ValueError):
        Retriever(docs(spark)).retrieve(q)
    with pytest.raises(ValueError):
        cf.RetrievalConfig(mode="other")
    assert cf.RERANKED.top_k == cf.RERANKED.reranker.top_k == 5


def test_rerank(spark):
    c = spark.createDataFrame([(1, "red apple", 1, "sky", 1, 3.0), (1, "red apple", 2, "red apple", 2, 2.0), (1, "", 3, "x", 3, 1.0)], "query_id bigint, query string, doc_id bigint, text string, rank bigint, score double")
    got = [(r.doc_id, r.rerank_rank, r.rerank_score) for r in rerank.rerank(c, top_k=2).orderBy("rerank_rank").collect()]
    assert got == [(2, 1, 1.0), (1, 2, 0.0)]


def _patches(spark, scores):
    return spark.createDataFrame([(1, 0, 5, f"p{i}", s, 0.1 * i, 0.2) for i, s in enumerate(scores)], "query_id bigint, doc_id bigint, page bigint, patch_id string, score double, x double, y double")


@pytest.mark.parametrize("how,value", [("max", 0.9), ("mean", 0.6), ("sum", 1.8), ("weighted", 1.3), ("other", 0.9)])
def test_page_scores(spark, how, value):
    assert visual.page_scores(_patches(spark, [0.9, 0.6, 0.3]), how).first().score == value


def test_page_scores_of_negatives(spark):
    assert visual.page_scores(_patches(spark, [-0.2, -0.4])).first().num_relevant == 0


def test_patch_grid(spark):
    p = spark.createDataFrame([(0, 1, 100, 200)], "doc_id bigint, page bigint, width bigint, height bigint")
    got = {r.patch_id: r for r in visual.grid(p).collect()}
    assert len(got) == 4 and (got["p001_r0_c1"].x, got["p001_r0_c1"].w, got["p001_r0_c0"].pixel_width, got["p001_r0_c0"].pixel_height) == (0.5, 0.5, 55, 110)


def test_heat_is_row_by_y(spark):
    row = visual.heat(_patches(spark, [0.5])).first()
    assert (row.cell_row, row.cell_col, row.heat) == (2, 0, 1.0)


def test_visual_summary():
    assert visual.summary("q", [], 3) == "No relevant pages found."
    assert "Top region: (0.10, 0.20), score: 0.500" in visual.summary("q", [{"page": 1, "score": 0.5, "patches": [{"x": 0.1, "y": 0.2, "score": 0.5}]}], 3)


def test_cache(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    p = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.0, 1.0]), (7, [0.0, 0.0])], "query_id bigint, vector array<float>")
    found = cache.lookup(e, p)
    assert [(r.hit, r.entry_id) for r in found.orderBy("probe_id").collect()] == [(True, 1), (False, None), (False, None)]
    assert cache.statistics(found).first()[:] == (1, 2, 3, round(1 / 3, 6))
    assert cache.statistics(found.limit(0)).first().hit_rate == 0
    for bad in ({"ttl_seconds": 0}, {"max_entries": 0}, {"threshold": 2}):
        with pytest.raises(ValueError):
            cache.CacheConfig(**bad)


def test_intent_without_words(spark):
    w = spark.createDataFrame([("hello",), ("table",)], "q string").select(multimodal.intent(F.col("q")).alias("w")).collect()
    assert tuple(w[0].w) == (0.6, 0.25, 0.15) and abs(sum(w[1].w) - 1) < 1e-9 and w[1].w.table_w > w[1].w.image_w


def test_combine_modes(spark):
    x = spark.createDataFrame([(1, r, r) for r in range(1, 9)], "query_id bigint, rank bigint, id bigint")
    assert multimodal.combine(x, x, x).count() == 10 and multimodal.combine(x, x, x, "tables").count() == 3


def test_structured_table(spark):
    rows = [["k", "", "k"], ["1", "2", "(3)", "x"], ["4"]]
    got = spark.createDataFrame([(rows,)], "r array<array<string>>").select(tables.structured(F.col("r")).alias("s")).first().s
    assert got.rows == [{"col_1": "2", "k": "(3)"}, {"k": "4"}] and got.normalized == [{"col_1": 2.0, "k": -3.0}, {"k": 4.0}]
    assert (got.row_count, got.col_count) == (2, 3)


def test_table_scan(spark):
    html = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2 <b>x</b></td></tr></table>"
    p = spark.createDataFrame([(1, html), (2, "a | b | c\n--|--|--\n1 | 2 | 3\nend"), (3, None)], "id bigint, body string")
    got = {r.id: r.rows for r in tables.scan(p, "id", "body").collect()}
    assert got == {1: [["a", "b"], ["1", "2 x"]], 2: [["a", "b", "c"], ["1", "2", "3"]]}
    assert tables.scan(p, "id", "body", "html").count() == 1
    with pytest.raises(ValueError):
        tables.scan(p, "id", "body", "pdf")


def test_recursive_chunks():
    text = "para one\n\n" + "word " * 300 + "\n\nlast"
    got = chunking.recursive(text, 200, 40)
    assert all(len(c) <= 200 for c in got) and got[0].startswith("para one") and got[-1].endswith("last")
    assert chunking.recursive("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9]
    assert chunking.recursive(None) == chunking.recursive("") == []


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300))
def test_chunks_are_bounded_and_lose_no_letters(text):
    got = chunking.recursive(text, 20, 5)
    assert all(0 < len(c) <= 20 for c in got)
    assert sum(c.count("a") for c in got) >= text.count("a")


def test_html_text(spark):
    html = '<title>T</title><script>var t="</p>";</script><p>a &amp; b<!-- x --></p>'
    assert spark.createDataFrame([(html,)], "h string").select(pages.html_text(F.col("h")), pages.html_title(F.col("h"))).first()[:] == ("T a & b", "T")


def test_sections_carry_forward(spark):
    p = spark.createDataFrame([("s", 1, "x"), ("s", 2, "Glossary"), ("s", 3, "y"), ("t", 1, "z")], "source string, page bigint, text string")
    assert [r.section for r in pages.sections(p).orderBy("source", "page").collect()] == ["Introduction", "Glossary", "Glossary", "Introduction"]


def test_prompts(spark):
    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    got = spark.range(1).select(prompts.multimodal_prompt(F.lit("q"), a("x"), a("y"), a()), prompts.multimodal_prompt(F.lit("q"), a(), a(), a())).first()
    assert got[0].count("=" * 50) == 1 and "No relevant context" in got[1]


def test_preference_rules(spark):
    def rule(query, overlap=5, only_b=0, similarity=0.0, ms=(1, 2), length=(10, 10)):
        c = [F.lit(v) for v in (query, overlap, 5, 5, only_b, similarity, *ms, *length)]
        return spark.range(1).select(compare.preferred(*c)).first()[0]

    assert [rule("show it"), rule("q", 1, 2), rule("q", similarity=0.8), rule("q", similarity=0.8, ms=(2, 1)), rule("q", length=(10, 16)), rule("q")] == ["b", "b", "a", "b", "b", "a"]


def test_word_overlap(spark):
    o = spark.range(1).select(compare.word_overlap(F.lit("a b c"), F.lit("B d")).alias("o")).first().o
    assert (o.common, o.only_a, o.only_b, o.jaccard, o.overlap) == (1, 2, 1, 0.25, round(1 / 3, 6))


def test_evaluation(spark):
    rows = evaluate.run_grid([{"k": 3}, {"k": 0}], lambda k: {"faithfulness": 1 / k})
    assert rows[0]["faithfulness"] == 1 / 3 and "division" in rows[1]["error"]
    assert "error" in evaluate.report(rows) and "0.333" in evaluate.report(rows)
    empty = F.array().cast("array<string>")
    m = spark.range(1).select(evaluate.metrics(F.lit("red apple"), F.lit("apple"), empty, F.lit("x y")).alias("m")).first().m
    assert (m.context_precision, m.context_recall, m.answer_relevance) == (0, 0, 0.5)


def test_parsed_json_and_paths(spark):
    row = spark.createDataFrame([('{"a": 1}',), ("x",), (None,)], "b string").select(prompts.parsed(F.col("b"), "a int").alias("p")).collect()
    assert [(r.p.value.a if r.p.value else None, r.p.failed) for r in row] == [(1, False), (None, True), (None, True)]
    assert spark.range(1).select(prompts.first_existing(F.lit(None).cast("string"), F.lit(""), F.lit("x.png"))).first()[0] == "x.png"


def test_page_lookups_and_failed_embeddings(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 2, "p1", "a b"), (1, 3, "p2", None)], "doc_id bigint, page bigint, patch_id string, text string")
    assert [r.patch_id for r in visual.page_patches(rows, 1, 3).collect()] == ["p2"]
    assert visual.patch(rows, "p1").count() == 1 and visual.patch(rows, "none").count() == 0
    out = visual.embedded(rows, F.col("text"), lambda c: F.when(c.isNotNull(), F.array(F.lit(1.0), F.lit(2.0))), 2).orderBy("page").collect()
    assert [(r.failed, r.embedding) for r in out] == [(False, [1.0, 2.0]), (True, [0.0, 0.0])]
    assert all(r.failed and r.embedding == [0.0] * 3 for r in visual.embedded(rows, F.col("text"), lambda c: F.array(F.lit(1.0)), 3).collect())


def test_contexts_tell_documents_apart(spark):
    pages = spark.createDataFrame([(1, 10, 3, 0.9), (1, 20, 3, 0.8)], "query_id bigint, doc_id bigint, page bigint, score double")
    images = spark.createDataFrame([(20, 3)], "doc_id bigint, page bigint")
    found = visual.contexts(pages, images)
    assert [(r.doc_id, r.page_rank) for r in found.collect()] == [(20, 2)] and visual.confidence(found).first().confidence == 0.8
    empty = spark.createDataFrame([], "doc_id bigint, page bigint, patch_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0])], "query_id bigint, vector array<double>")
    assert visual.retrieve(empty, asked).count() == 0


def test_best_of_a_batch():
    import numpy as np

    from sparquill.operators import dense

    s = np.array([[1.0, 3.0, 3.0, 3.0], [0.0, 0.0, 0.0, 5.0]])
    rows, at = dense.best(s, np.array([4, 9, 2, 7]), 2)
    assert list(zip(rows.tolist(), at.tolist())) == [(0, 2), (0, 3), (1, 3), (1, 2)]
    rows, at = dense.best(s[:, :1], np.array([4]), 2)
    assert list(zip(rows.tolist(), at.tolist())) == [(0, 0), (1, 0)]
