import pytest
from pyspark.sql import functions as F

from sparquill.llm import quality, queries, toxicity

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query,label,least", [(queries.op3_quality, "quality", 0.95), (queries.op4_toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, query, label, least):
    out = query(spark, DIR)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").where("held_out")
    right = rows.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    clean = rows.where(f"{label} = {0 if label == 'toxic' else 1}").agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right >= least and clean >= 0.99
    assert out.where("score < 0 or score > 1 or score is null").count() == 0 and out.count() == 1000


def _labels(spark, rows):
    return spark.createDataFrame(rows, "key long, label int")


EDGES = ["", None, "x " * 40_000, "😀 !!", "same", "same"]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edges(spark, documents, module):
    docs = spark.createDataFrame([(i, ("idiot scum " if i % 2 else "nice words ") * 5) for i in range(60)], "key long, text string")
    model = module.fit(docs, _labels(spark, [(i, i % 2) for i in range(60)] + [(3, None), (999, 1)]))
    rows = module.score(documents(EDGES), model).orderBy("doc_id").collect()
    assert all(0 <= r.score <= 1 for r in rows) and rows[4].score == rows[5].score
    assert module.score(documents(EDGES).limit(0), model).count() == 0
    near = module.score(docs, model).groupBy((F.col("key") % 2).alias("y")).agg(F.avg("score").alias("s")).orderBy("y").collect()
    assert near[0].s < 0.3 and near[1].s > 0.7


@pytest.mark.parametrize("module", [quality, toxicity])
@pytest.mark.parametrize("labels,prior", [([], 0.5), ([(i, 1) for i in range(40)], 1.0)])
def test_labels_of_one_class(spark, documents, module, labels, prior):
    docs = spark.createDataFrame([(i, "some words") for i in range(40)], "key long, text string")
    model = module.fit(docs, _labels(spark, labels))
    assert {r.score for r in module.score(documents(EDGES), model).collect()} == {prior}


def test_counts_grow_with_the_input(spark):
    docs = spark.createDataFrame([("abc", 1), ("abc", 0), ("abc d", 0)], "text string, label int")
    rows = toxicity.count(docs).collect()
    assert sum(r.n1 for r in rows if not r.kind) == 4 and sum(r.n0 for r in rows if not r.kind) == 10
    assert sorted((r.n0, r.n1) for r in rows if r.kind == 1) == [(1, 0), (2, 1)]
    assert [(r.n0, r.n1) for r in rows if r.kind == 2] == [(1, 0)]


def test_word_model_against_brute_force(spark):
    """Ratios of words and pairs of words by the Kneser-Ney formulas, from texts."""
    import math
    import random
    from collections import Counter, defaultdict

    import numpy as np

    rng = random.Random(4)
    texts = [(" ".join(rng.choice("red old fat cat dog hat man sun".split()) for _ in range(6)) + (" bad egg" if y and rng.random() < 0.7 else " egg"), y) for y in [0, 0, 1] * 20]
    n, m, before = (Counter(), Counter()), (Counter(), Counter()), defaultdict(set)
    for t, y in texts:
        words = t.split()
        n[y].update(set(words))
        m[y].update(set(zip(words, words[1:])))
        for v, w in zip(words, words[1:]):
            before[w].add(v)
    over = lambda c: {k: max(x - 1, 0) for k, x in c.items()}
    single, double = [over(c) for c in n], [over(c) for c in m]
    share = 1 - sum(sum(o.values()) for o in single) / sum(sum(c.values()) for c in n)
    vocabulary = set(n[0]) | set(n[1])
    base = {w: len(before[w]) + toxicity.FLOOR for w in vocabulary}
    p = [{w: (1 - share) * o.get(w, 0) / sum(o.values()) + share * base[w] / sum(base.values()) for w in vocabulary} for o in single]
    want = {}
    for v, w in set(m[0]) | set(m[1]):
        if m[1][v, w] > 1:
            mine = [{k: x for k, x in o.items() if k[0] == v} for o in double]
            left = 1 - sum(sum(o.values()) for o in mine) / sum(x for c in m for k, x in c.items() if k[0] == v)
            q = [(1 - left) * mine[c].get((v, w), 0) / max(sum(mine[c].values()), 1) + left * p[c][w] for c in (0, 1)]
            want[v, w] = math.log(max(q[1], 1e-12) / max(q[0], 1e-12))
    tables = toxicity.ratios(toxicity.count(spark.createDataFrame(texts, "text string, label int")))
    words = sorted(vocabulary)
    assert np.allclose(toxicity.look_up(tables[2], toxicity.word_keys(words), 0.0), [math.log(p[1][w] / p[0][w]) for w in words], atol=1e-5)
    pairs = sorted(want)
    keys = toxicity.pair_keys(toxicity.word_keys([v for v, _ in pairs]), toxicity.word_keys([w for _, w in pairs]))
    assert want and len(tables[3][0]) == len(want) and np.allclose(toxicity.look_up(tables[3], keys, np.nan), [want[k] for k in pairs], atol=1e-5)


def test_words_share_no_ratio(spark):
    """Two seen words whose keys agree in their low bits, one of a single document, and an unseen one."""
    import numpy as np

    keys = [5 + (i << 20) for i in range(4)]
    rows = [(1, keys[0], 0, 0, 50), (1, keys[1], 0, 50, 0), (1, keys[2], 0, 1, 0), (0, 0x6162636465, 0, 9, 1)]
    tables = toxicity.ratios(spark.createDataFrame(rows, "kind int, key long, word long, n0 long, n1 long"))
    toxic, clean, once, unseen = toxicity.look_up(tables[2], np.array(keys), 0.0)
    assert toxic > 0.5 and clean < -0.5 and once == unseen == 0
