import random
from itertools import combinations

import pytest

from sparquill.llm import common, minhash
from sparquill.llm.components import components


def sets_of(text, size=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(texts, percent):
    s = [sets_of(t) for t in texts]
    root = list(range(len(s)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(s)), 2):
        if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return [(i, len(s[i]), top(i), top(i) == i) for i in range(len(s))]


def copies(seed, groups, size, words=80, edits=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(rng.randrange(1, size)):
            own = list(base)
            for _ in range(rng.randrange(edits)):
                own[rng.randrange(words)] = word()
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


EDGES = ["", None, "  \n", "one", "ONE", "two words", "one two three four five", "one two three four five", "x " * 30_000, "y z " * 20_000]


def _rows(df):
    return [tuple(r)[:4] for r in df.select("doc_id", "n_shingles", "component_id", "kept").orderBy("doc_id").collect()]


@pytest.mark.parametrize("percent", [80, 85])
def test_against_brute_force(spark, documents, percent):
    texts = EDGES + copies(1, 12, 9)
    assert _rows(minhash.group(documents(texts), percent=percent)) == brute(texts, percent)


def test_dense_regions_and_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(minhash, "SIZES", (4, 10_000))
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    texts = copies(2, 2, 90, edits=7)
    assert _rows(minhash.group(documents(texts), percent=85)) == brute(texts, 85)


def test_dense_regions_miss_no_more_than_sparse_ones(spark, documents):
    """A star: copies at the threshold to their base, but far from one another."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(304)]
    texts = [" ".join(base)]
    for c in range(300):
        own = list(base)
        for i in rng.sample(range(12, 292, 5), 6):
            own[i] = f"c{c}x{i}"
        texts.append(" ".join(own))
    assert _rows(minhash.group(documents(texts), percent=80)) == brute(texts, 80)


def test_one_odd_row_does_not_open_the_square(spark):
    rows = [(7, i, 0) for i in range(5000)] + [(7, 6000, 6000)] + [(8, i, i % 300 + 10_000) for i in range(7000, 8000)]
    members = spark.createDataFrame(rows, "region long, node long, root long")
    dealt = minhash._blocks(members).where("region = 7")
    assert dealt.groupBy("i", "j").count().agg({"count": "max"}).first()[0] <= 2 * minhash.BLOCK_ROWS
    assert dealt.count() < 2 * 5001 and dealt.select("node").distinct().count() == 5001
    met = minhash._blocks(members).groupBy("region", "i", "j").agg({"node": "collect_set"}).collect()
    both = [set(r[3]) for r in met]
    assert all(any({6000, i} <= b for b in both) for i in range(0, 5000, 97))
    assert all(any({7001, i} <= b for b in both) for i in range(7002, 8000))


def test_near_copies_without_ids(spark, documents):
    texts = copies(5, 3, 9)
    out = minhash.group(documents(texts, [None] * len(texts)))
    want = {}
    for (i, _, top, _), t in zip(brute(texts, 80), texts):
        want.setdefault(top, set()).add(t)
    assert out.select("root").distinct().count() == len(want) and all(r.component_id is None for r in out.collect())
    kept = minhash.kept_rows(minhash.group(documents(texts + [""], [None] * (len(texts) + 1))))
    assert kept.count() == len(want) + 1


def test_repeated_and_null_ids(spark, documents):
    out = minhash.group(documents(["a b c d e f"] * 3 + ["other words"], [5, 5, None, 9]))
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in out.collect()) == [(-1, 5, False), (5, 5, True), (5, 5, True), (9, 9, True)]
    assert minhash.group(documents([])).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.range(1, 300).selectExpr("id as a", "id - 1 as b").unionByName(spark.createDataFrame([(1000, 1001), (5, 5)], "a long, b long"))
    got = dict(map(tuple, components(links).collect()))
    assert got == {i: 0 for i in range(300)} | {1000: 1000, 1001: 1000}


def test_stored_tables_are_released(spark):
    common._written.clear()
    df = common.stored(spark.range(3), "x")
    assert df.count() == 3
    common.release(spark)
    assert not common._written
