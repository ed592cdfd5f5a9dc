import math

import numpy as np
import pytest

from sparquill.llm import ann, queries


def brute(rows, asked, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in usable:
        if q in asked:
            best = sorted({(-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 12), i) for i, b in usable if i != q and len(a) == len(b)})[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(set(out))


def _got(df):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in df.collect())


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [0.0, 1.0]), (8, [3.0, 0.0]), (None, [1.0, 1.0]), (9, []), (10, [1.0, 2.0, 3.0]), (1, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert _got(ann.search(df, df.where("vec_id in (0, 2, 3, 10)"), 5)) == brute(rows, {0, 10}, 5)
    assert ann.search(df.limit(0), df.limit(0), 5).count() == 0


def test_recall_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 60)
    monkeypatch.setattr(ann, "PAGE_ROWS", 4)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 24)).astype(np.float32) + 2 * rng.standard_normal((12, 24))[rng.integers(0, 12, 1500)].astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = {i for i in range(1500) if i % 50 == 0}
    got = _got(ann.search(df, df.where("vec_id % 50 = 0"), 5))
    want = {(q, i) for q, _, i, _ in brute(rows, asked, 5)}
    assert len(got) == 150 and len(want & {(q, i) for q, _, i, _ in got}) / len(want) >= 0.95


def test_far_cells_stay_closed():
    rng = np.random.default_rng(2)
    centres = 20 * rng.standard_normal((40, 24))
    x = centres[rng.integers(0, 40, 8000)] + 0.2 * rng.standard_normal((8000, 24))
    points = ann.projected(x)
    cells = ann.Cells(points, 32)
    own = cells.route(points)
    assert len(cells.low) == 32 and np.bincount(own, minlength=32).min() > 0
    assert all((cells.low[c] <= p).all() and (p <= cells.high[c]).all() for c, p in zip(own, points))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    bound = np.sort(unit[:50] @ unit.T, 1)[:, -6]
    opened = [len(cells.open_to(p, ann.far_of(b))) for p, b in zip(points[:50], bound)]
    assert np.mean(opened) < 6


def test_very_large_and_very_small_components(spark):
    rows = [(0, [1.0, 1.0]), (1, [1e-170, 0.0]), (2, [1e200, 1e200]), (3, [5e-324, 5e-324]), (4, [0.0, 1e300]), (5, [1.0, 0.9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    half = round(math.sqrt(0.5), 12)
    got = _got(ann.search(df, df.where("vec_id in (0, 1)"), 5))
    assert got[:5] == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 5, round(1.9 / math.sqrt(2 * 1.81), 12)), (0, 4, 1, half), (0, 5, 4, half)]
    assert [g[3] for g in got[5:]] == [round(1 / math.sqrt(1.81), 12), half, half, half, 0.0]


def test_several_vectors_of_one_id(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.1, 1.0]), (3, [1.0, 0.1]), (3, [0.1, 1.0])], "vec_id long, embedding array<float>")
    assert [r[1:3] for r in _got(ann.search(df, df.where("vec_id = 1"), 5))] == [(1, 2), (2, 3)]
    assert [r[1:3] for r in _got(ann.search(df, df.where("vec_id = 2"), 5))] == [(1, 3), (2, 1)]


def test_rows_that_repeat_an_id_take_one_place(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])] * 50 + [(i, [1.0, 0.1 * i]) for i in range(2, 9)], "vec_id long, embedding array<float>")
    assert [r[2] for r in _got(ann.search(df, df.where("vec_id = 2"), 3))] == [3, 4, 1]


def test_many_equal_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(400)], "vec_id long, embedding array<float>")
    assert [r[2] for r in _got(ann.search(df, df.where("vec_id = 50"), 5))] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("x,dims,p", [(18.307, 10, 0.95), (13.362, 8, 0.9)])
def test_chi_square(x, dims, p):
    assert abs(ann.chi_square(x, dims) - p) < 1e-3 and abs(ann.chi_square_point(p, dims) - x) < 1e-2


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want = {(q, i) for q, _, i, _ in brute(rows, {i for i, _ in rows if i % 50 == 0}, 5)}
    got = {(q, i) for q, _, i, _ in _got(queries.op8_nearest(spark, d))}
    assert len(want & got) / len(want) >= 0.95
