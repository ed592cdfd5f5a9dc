import sys
from pathlib import Path

import tiktoken

import corpus_pipeline as cp
from sparquill.llm import queries

sys.path.insert(0, str(Path(__file__).parent))
from test_minhash import brute as brute_groups
from test_decontaminate import brute as brute_overlaps
from test_pii import brute as brute_spans

DIR = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    kept = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        columns = docs.columns
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert len(kept[name]) == docs.count()
        if k < len(cp.STAGES) - 1:
            assert docs.columns == columns
        ids = sorted(before)
        if name == "near duplicates":
            want = {ids[i] for i, _, _, keep in brute_groups([before[i].text for i in ids], cp.SIMILAR) if keep}
            assert set(kept[name]) == want
        elif name == "decontamination":
            assert set(kept[name]) == {i for i in ids if not brute_overlaps(before[i].text, items)}
        elif name == "personal data":
            assert set(kept[name]) == set(before)
            assert not any(brute_spans(r.text) for r in kept[name].values())
            assert all(r.n_chars == len(r.text) for r in kept[name].values())
        elif name == "tokens":
            ranks, pattern = queries.tokenizer()
            library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            assert all(list(r.ids) == library.encode_ordinary(before[i].text) and r.n_tokens == len(r.ids) for i, r in kept[name].items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    clean = [i for i, y in labels.items() if y == 0]
    assert sum(i in kept["toxicity"] for i in clean) >= 0.95 * len(clean)  # five toxic documents to learn from at this size
    assert cp.ORACLE_SQL is None


def test_run_is_the_stages(spark):
    out = cp.run(spark, DIR)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and 0 < out.count() < 200


def test_different_texts_of_one_id_are_kept_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(7, a), (7, b), (7, a), (8, a + " more"), (None, b), (None, "c " + " ".join(f"c{i}" for i in range(30))), (None, "c " + " ".join(f"c{i}" for i in range(30))), (9, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.without_copies(spark, docs, DIR)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or -1, (r.text or "")[:2]) for r in out.collect()) == [(-1, "c "), (7, "a0"), (7, "b0"), (9, ""), (9, "")]


def test_edges(spark):
    docs = spark.createDataFrame([(None, "", "en", "s", 0), (None, None, "en", "s", 0), (1, "word " * 5000, "en", "s", 1), (1, "word " * 5000, "en", "s", 1), (2, "a@b.cd", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        out = stage(spark, docs, DIR.replace("0.001", "0.01"))
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert sorted((r.doc_id or -1) for r in docs.collect()) == [-1, -1, 1, 2]
