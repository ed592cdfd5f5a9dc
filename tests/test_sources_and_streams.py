from datetime import datetime
from types import SimpleNamespace

import pytest

from sparquill.operators import bm25
from sparquill.operators.cache import CacheConfig
from sparquill.plans.config import RetrievalConfig, Settings
from sparquill.plans.retriever import retrieve
from sparquill.session import work_dir
from sparquill.sources import files
from sparquill.streaming import cache, traffic


def test_pages_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(1, "a\nb", 1.0, 2.0)], files.PAGES)
    files.write_pages(p, str(tmp_path / "p"))
    assert files.read_pages(spark, str(tmp_path / "p")).collect() == p.collect()


def test_questions(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('Question,Ground_Truth_Context,Ground_Truth_Answer,Page_Number,Context_Content_Type\n" What ""x""?","a, b\nc", yes ,4; 8,text\n')
    row = files.read_questions(spark, str(path)).first()
    assert (row.question, row.ground_truth_context, row.ground_truth_answer, row.pages, row.content_type) == ('What "x"?', "a, b\nc", "yes", [4, 8], "text")


def test_missing_table_is_empty(spark, tmp_path):
    assert files.read_or_empty(spark, str(tmp_path / "none"), files.PATCHES).count() == 0


def test_modalities(spark, tmp_path):
    rows = spark.createDataFrame([("text", 1), ("image", 2)], "modality string, id bigint")
    files.write_modalities(rows, str(tmp_path / "m"))
    assert [r.id for r in files.read_modality(spark, str(tmp_path / "m"), "image").collect()] == [2]


def test_missing_modality_is_none(spark, tmp_path):
    assert files.read_modality(spark, str(tmp_path / "none"), "image") is None


def test_stores_by_kind(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue hen"), (3, "red hen")], "doc_id bigint, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    files.write_dense(docs, vectors, str(tmp_path / "dense"))
    assert sorted(files.load_dense(spark, "parquet", str(tmp_path / "dense")).columns) == ["doc_id", "embedding", "text"]
    with pytest.raises(ValueError):
        files.load_dense(spark, "other", str(tmp_path / "dense"))
    with pytest.raises(FileNotFoundError):
        files.load_dense(spark, "parquet", str(tmp_path / "none"))
    asked = spark.createDataFrame([(7, "red hen", [1.0, 0.1])], "query_id bigint, text string, vector array<double>")
    alone = files.load_retriever(spark, "parquet", str(tmp_path / "dense"), str(tmp_path / "bm25"))
    assert alone.index is None and alone.retrieve(asked).first().doc_id == 1
    bm25.save(bm25.build(docs), str(tmp_path / "bm25"))
    both = files.load_retriever(spark, "parquet", str(tmp_path / "dense"), str(tmp_path / "bm25"))
    assert both.retrieve(asked, RetrievalConfig(mode="sparse")).first().doc_id == 3
    assert [r.doc_id for r in both.similarity_search(asked, 2).collect()] == [r.doc_id for r in retrieve(both, asked, 2).collect()] == [1, 3]
    assert [r.text for r in retrieve(both, asked, 1, RetrievalConfig(mode="sparse", top_k=9)).collect()] == ["red hen"]


def test_manifest_rows_without_a_file_are_skipped(spark, tmp_path):
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "a.png").write_bytes(b"x")
    (tmp_path / "m.json").write_text('{"file_name": "a.png", "page": 1}\n{"file_name": "b.png", "page": 2}\n')
    schema = "file_name string, page int"
    read = lambda manifest, folder: [r.page for r in files.read_manifest(spark, str(tmp_path / manifest), str(tmp_path / folder), schema).collect()]
    assert read("m.json", "images") == [1] and read("none.json", "images") == [] and read("m.json", "none") == []


def test_sample_names_and_summary(spark, tmp_path):
    at = datetime(2024, 5, 6, 7, 8, 9)
    assert files.sample_name("a", 5, at=at) == "eval_samples_a_k5_20240506_070809"
    assert files.sample_name("a", 5, "hybrid", True, at) == "eval_samples_a_k5_hybrid_reranked_20240506_070809"
    runs = [{"config": {"k": 5}, "aggregated_metrics": {"faithfulness": 0.5}, "judge_avg_score": 0.25, "samples": [1, 2]}, {"config": {"k": 3}}]
    files.write_summary(spark, runs, str(tmp_path / "x"))
    rows = spark.read.json(str(tmp_path / "x")).collect()
    assert {r.config.k: r.judge_avg_score for r in rows} == {"5": 0.25, "3": None} and "samples" not in rows[0].asDict()


def test_extract_all(spark, tmp_path):
    html = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>"
    pages = spark.createDataFrame([(1, "one", html, [("f1", "a map")]), (2, "two", None, [])], "page int, text string, html string, images array<struct<figure_id:string,description:string>>")
    assert files.extract_all(pages, str(tmp_path / "a"), about={"title": "t"}) == {"text_pages": 2, "images": 1, "tables": 1}
    assert files.extract_all(pages, str(tmp_path / "b"), skip_images=True, skip_tables=True) == {"text_pages": 2, "images": 0, "tables": 0}
    assert not (tmp_path / "b" / "figures").exists() and spark.read.text(str(tmp_path / "a" / "metadata")).first().value == '{"title": "t"}'


def test_work_folder_is_shared_off_a_local_master():
    conf = SimpleNamespace(get=lambda key, default: None)
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            work_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="a")))
    assert work_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]", applicationId="b"))) == work_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local", applicationId="b")))


def test_settings():
    s = Settings.load({"SPARQUILL_DENSE_PATH": " ", "SPARQUILL_SPARSE_PATH": "s3a://x/y", "SPARQUILL_SAMPLES": "runs"}, "/data")
    assert (s.dense_path, s.sparse_path, s.samples, s.dense_kind) == ("/data/index/dense", "s3a://x/y", "/data/runs", "parquet")


def test_vectors_and_samples(spark, tmp_path):
    files.write_vectors(spark.createDataFrame([(1, [3.0, 4.0])], "vec_id bigint, embedding array<float>"), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).first().unit == [0.6, 0.8]
    files.write_samples(spark.createDataFrame([("a", 1)], "config string, id bigint"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 1


def test_pdf_needs_a_library(spark):
    with pytest.raises(ImportError):
        files.read_pdf(spark, "x.pdf")


def test_stateful_cache(spark, tmp_path):
    rows = [(1, 1, 0.0, [1.0, 0.0]), (1, 2, 1.0, [1.0, 0.01]), (1, 3, 2.0, [0.0, 1.0]), (2, 4, 0.0, [1.0, 0.0])]
    later = [(1, 5, 3.0, [0.0, 1.0]), (1, 6, 50.0, [0.0, 1.0])]
    schema = "shard bigint, request_id bigint, ts double, vector array<double>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = cache.stream(stream, CacheConfig(ttl_seconds=20)).writeStream.format("memory").queryName("lookups").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        spark.createDataFrame(later, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.request_id: (r.hit, r.entry_id) for r in spark.table("lookups").collect()}
    assert got == {1: (False, None), 2: (True, 1), 3: (False, None), 4: (False, None), 5: (True, 3), 6: (False, None)}


def test_cache_evicts_the_oldest():
    import numpy as np

    entries = []
    for i in range(3):
        cache.step(entries, i, float(i), np.eye(3)[i], CacheConfig(max_entries=2))
    assert [e[0] for e in entries] == [1, 2]


def test_traffic_windows_on_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = traffic.windows(stream).writeStream.outputMode("complete").format("memory").queryName("traffic").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("traffic")) == key(traffic.windows(events))
    assert traffic.sessions(events).count() > 0
