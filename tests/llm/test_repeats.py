import random

import pytest

from sparquill.llm import queries, substrings, suffixes


def brute_words(rows, size):
    first = {}
    cut = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in cut:
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in cut:
        gone = set()
        for p in range(len(w) - size + 1):
            if i is not None and first[tuple(w[p : p + size])] < i:
                gone |= set(range(p, p + size))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def brute_bytes(rows, size):
    raws = [(t or "").encode() for _, t in rows]
    count = {}
    for r in raws:
        for p in range(len(r) - size + 1):
            count[r[p : p + size]] = count.get(r[p : p + size], 0) + 1
    out = []
    for (i, _), r in zip(rows, raws):
        gone = [False] * len(r)
        for p in range(len(r) - size + 1):
            if count[r[p : p + size]] > 1:
                gone[p : p + size] = [True] * size
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(r), sum(gone), spans, bytes(c for c, g in zip(r, gone) if not g)))
    return out


def passages(seed, n=40, alphabet=40, length=60):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(alphabet)}"
    shared = [[word() for _ in range(rng.randrange(10, length))] for _ in range(5)]
    out = []
    for _ in range(n):
        parts = [[word() for _ in range(rng.randrange(20))]]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts += [s[a : a + rng.randrange(8, length)], [word() for _ in range(rng.randrange(10))]]
        out.append(" ".join(w for p in parts for w in p))
    return out


EDGES = ["", None, " \t\n", "a " * 60, "a " * 45 + "b", "short text", "é " * 30 + "\x1f sep word", "é " * 30]


@pytest.mark.parametrize("most", [1 << 20, 0])
@pytest.mark.parametrize("alphabet", [2, 40, 4000])
def test_substrings_against_brute_force(spark, documents, most, alphabet):
    texts = EDGES + passages(alphabet, alphabet=alphabet)
    ids = list(range(len(texts)))
    random.Random(7).shuffle(ids)
    got = substrings.deduplicate(documents(texts, ids), most_keys=most).collect()
    assert sorted(map(tuple, got)) == sorted(brute_words(list(zip(ids, texts)), 13))


def test_substrings_with_repeated_and_null_ids(spark, documents):
    text = " ".join(f"w{i}" for i in range(20))
    got = substrings.deduplicate(documents([text, text, text, "x " + text], [5, 5, None, 9])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (5, 0), (5, 0), (9, 20)]
    assert substrings.deduplicate(documents([])).count() == 0


@pytest.mark.parametrize("alphabet", [2, 40, 4000])
def test_suffixes_against_brute_force(spark, documents, alphabet):
    texts = EDGES + passages(alphabet + 1, alphabet=alphabet) + ["same row of some words"] * 2
    rows = list(enumerate(texts))
    got = suffixes.deduplicate(documents(texts), size=40, gram=4, reach=6)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect())
    assert got == brute_bytes(rows, 40)


def test_suffixes_with_repeated_and_null_ids(spark, documents):
    text = " ".join(f"w{i}" for i in range(30))
    got = suffixes.deduplicate(documents([text, text, "other", text[:30]], [5, 5, None, None]), size=40, gram=4, reach=6).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, len(text), len(text)]
    assert suffixes.deduplicate(documents([]), size=40, gram=4, reach=6).count() == 0


def test_queries(spark):
    d = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    import hashlib

    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted(map(tuple, queries.op7_substrings(spark, d).collect())) == sorted((i, n, k, sha(t.encode())) for i, n, k, t in brute_words(texts, 13))
    assert sorted(map(tuple, queries.op9_suffixes(spark, d).collect())) == sorted((i, n, k, s, sha(t)) for i, n, k, s, t in brute_bytes(texts, 400))
