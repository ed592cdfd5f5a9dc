import random

import pytest

from sparquill.llm import decontaminate as dc
from sparquill.llm import queries


def brute(document, items):
    w, out = dc.words_of(document), set()
    for item, text in items:
        v = dc.words_of(text)
        n = min(dc.WINDOW, len(v))
        for a in range(len(v) - n + 1):
            for b in range(len(w) - n + 1):
                if n and 100 * sum(x == y for x, y in zip(v[a : a + n], w[b : b + n])) >= dc.PERCENT * n:
                    out.add(item)
    return sorted(out)


def test_against_brute_force(spark, documents):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 4, 5, 6, 9, 12, 13, 14, 20, 40, 40])] + [(50, ""), (51, None)]
    texts = ["", None, "z " * 20_000]
    for _ in range(60):
        v = rng.choice(items[:12])[1].split()
        a = rng.randrange(len(v))
        part = v[a:] if rng.random() < 0.5 else v
        part = [word() if rng.random() < 0.12 else x for x in part]
        texts.append(" ".join([word() for _ in range(rng.randrange(6))] + part + [word() for _ in range(rng.randrange(6))]))
    docs = documents(texts).withColumnRenamed("score", "items")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.judge(docs, dc.find(docs, bench)).orderBy("doc_id").collect()
    assert [r["items"] for r in rows] == [brute(t, items) for t in texts]
    assert all(r.contaminated == bool(r["items"]) and r.n_items == len(r["items"]) and (r.n_overlap > 0) == r.contaminated for r in rows)


def test_masks_hold_a_hit_for_each_two_substitutions():
    n = dc.WINDOW
    for a in range(n):
        for b in range(a):
            assert any(all(o + i not in (a, b) for i, c in enumerate(m) if c == "1") for m in dc.MASKS for o in range(n - len(m) + 1))


def test_overlap_runs():
    item = [b"%d" % i for i in range(20)]
    assert dc.overlap([b"x", *item, b"y"], item, 1) == [(1, 21)] and dc.overlap(item[:5], item, 0) == []


@pytest.mark.parametrize("ids", [[1, 1, None]])
def test_empty_and_repeated(spark, documents, ids):
    text = " ".join(f"w{i}" for i in range(20))
    docs = documents([text, "clean", text], ids)
    bench = spark.createDataFrame([(3, text), (3, text)], "item_id long, text string")
    assert sorted(r.contaminated for r in dc.judge(docs, dc.find(docs, bench)).collect()) == [False, True, True]
    assert not any(r.contaminated for r in dc.judge(docs, dc.find(docs, bench.limit(0))).collect())
    assert dc.judge(docs.limit(0), dc.find(docs.limit(0), bench)).count() == 0


def test_items_with_null_ids_contaminate(spark, documents):
    texts = [" ".join(f"{c}{i}" for i in range(20)) for c in "abc"]
    bench = spark.createDataFrame([(None, texts[0]), (None, texts[1])], "item_id long, text string")
    docs = documents([f"see {t} end" for t in texts])
    rows = dc.judge(docs, dc.find(docs, bench)).orderBy("doc_id").collect()
    assert [(r.contaminated, r.n_items, r.n_overlap) for r in rows] == [(True, 0, 20), (True, 0, 20), (False, 0, 0)]


def test_query_on_a_fixture(spark, tmp_path):
    """Documents and items of the test tables, with substitutions put into the passages that they share, as the query has them."""
    rng, d = random.Random(8), "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").limit(25).collect()]
    texts = [r.text[:1500] for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").limit(50).collect()]
    for i, text in items:
        words = text.split()[: rng.choice([13, 20, 60])]
        for k in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"other{k}"
        texts.append(rng.choice(texts[:50])[:200] + " " + " ".join(words) + " end")
    rows = list(enumerate(texts)) + [(len(texts), None), (len(texts) + 1, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.contaminated, r["items"]) for r in queries.op10_decontaminate(spark, str(tmp_path)).collect()}
    want = {i: brute(t, items) for i, t in rows}
    assert got == {i: (bool(w), ",".join(map(str, w))) for i, w in want.items()} and sum(map(bool, want.values())) > 10
