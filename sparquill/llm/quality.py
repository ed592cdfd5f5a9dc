"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text becomes weighted terms: shapes of its words (letters, capitals, digits and runs collapsed, other
signs kept), its short words, and bands of a few whole-text measures (share of different words, of the
commonest word, of repeated lines, mean line and word length). Terms hash to TERMS columns, weigh
log(1 + count) * inverse document frequency, and are projected on the first RANK right singular vectors
of the labelled rows. These labelled vectors, SAMPLE_ROWS of each label at most, are broadcast; every
document is compared with all of them by blocked exact cosine products, and its NEIGHBOURS nearest vote
with their similarity. Votes are weighted back to the labels' true shares.

Edge cases: a null or empty text has the terms of an empty text and is scored like any other; without
usable labels the score is their mean (0.5 without any); null labels are left out; ties among neighbours
go to the earlier labelled row; repeated rows are scored alike.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

TERMS, RANK, NEIGHBOURS, SAMPLE_ROWS = 1024, 32, 25, 2000
SHARPNESS = 8
_SHAPES = bytes.maketrans(bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x30, 0x3A)) + bytes(range(0x80, 0x100)), b"A" * 26 + b"a" * 26 + b"0" * 10 + b"a" * 128)
_RUNS = re.compile(rb"(.)\1+", re.S)


def terms(text: str | None) -> dict[int, float]:
    raw = (text or "").encode("utf-8", "replace")
    words, lines = raw.split(), raw.split(b"\n")
    counts: Counter = Counter()
    for shape, n in Counter(raw.translate(_SHAPES).split()).items():
        counts[b"s" + _RUNS.sub(rb"\1", shape)[:12]] += n
    seen = Counter(words)
    for w, n in seen.items():
        if len(w) <= 4:
            counts[b"w" + w.lower()] += n
    out: dict[int, float] = {}
    for k, n in counts.items():
        at = zlib.crc32(k) % TERMS
        out[at] = out.get(at, 0.0) + np.log1p(n / max(len(words), 1) * 100) * (1.0 if k[:1] == b"s" else 0.25)
    n = max(len(words), 1)
    measures = {
        b"different": len(seen) / n / min(1.0, 60 / n) ** 0.25,
        b"commonest": max(seen.values(), default=0) / n,
        b"lines": 1 - len(set(lines)) / len(lines),
        b"line": np.log2(1 + n / len(lines)) / 10,
        b"word": min(1.0, len(raw) / n / 20),
        b"size": np.log2(n) / 16,
    }
    for name, value in measures.items():
        place = min(max(value, 0.0), 1.0) * 12
        for step, share in ((int(place), 1 - place % 1), (int(place) + 1, place % 1)):  # shared by two bands, so that near values are near
            at = zlib.crc32(b"m%s%d" % (name, step)) % TERMS
            out[at] = out.get(at, 0.0) + 2.0 * share
    return out


def project(texts: list[str | None], weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit rows of latent dimensions."""
    rows = [terms(t) for t in texts]
    out = np.zeros((len(rows), basis.shape[1]), np.float32)
    for i, r in enumerate(rows):
        at = np.fromiter(r, np.int64, len(r))
        v = np.fromiter(r.values(), np.float32, len(r)) * weights[at]
        out[i] = v @ basis[at] / max(float(np.linalg.norm(v)), 1e-9)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """docs(key, text), labels(key, label): a bounded sample of each label, the first SAMPLE_ROWS by hash of the key."""
    labels = labels.where("label in (0, 1)").select("key", "label").withColumn("__h", F.xxhash64(F.col("key").cast("string")))
    shares = {int(r[0]): int(r[1]) for r in labels.groupBy("label").count().collect()}  # two rows
    got = []
    for c in sorted(shares):
        some = labels.where(F.col("label") == c).orderBy("__h", "key").limit(SAMPLE_ROWS)
        got.append(docs.join(F.broadcast(some), "key").select("__h", "key", "text", "label").toArrow().sort_by([("__h", "ascending"), ("key", "ascending")]))
    model = {"prior": shares.get(1, 0) / max(1, sum(shares.values())) if shares else 0.5, "data": None}
    if sum(len(g) > 0 for g in got) == 2:
        texts = [t for g in got for t in g.column("text").to_pylist()]
        y = np.array([c for g in got for c in g.column("label").to_pylist()], np.float32)
        x = np.zeros((len(texts), TERMS), np.float32)
        for i, t in enumerate(texts):
            r = terms(t)
            x[i, list(r)] = list(r.values())
        weights = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.2
        x *= weights
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        _, vectors = np.linalg.eigh(x.T @ x)
        basis = np.ascontiguousarray(vectors[:, ::-1][:, :RANK]).astype(np.float32)
        z = x @ basis
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        vote = np.array([shares[int(c)] / (y == c).sum() for c in y], np.float32)
        model["data"] = docs.sparkSession.sparkContext.broadcast((weights, basis, np.ascontiguousarray(z.T), y, vote))
    return model


def score(df: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add ``score_col``: share of the neighbours' votes for label 1, from 0 to 1."""
    if model["data"] is None:
        return df.withColumn(score_col, F.lit(float(model["prior"])))
    data = model["data"]

    def make():
        weights, basis, z, y, vote = data.value

        def work(columns):
            near = project(columns[0].to_pylist(), weights, basis) @ z
            k = min(NEIGHBOURS, near.shape[1])
            top = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1)
            w = np.clip(np.take_along_axis(near, top, 1), 0.0, 1.0) ** SHARPNESS * vote[top] + 1e-12
            return [pa.array(np.clip((w * y[top]).sum(1) / w.sum(1), 0.0, 1.0).astype(np.float64))]

        return work

    return common.append_arrow(df, [text_col], make, [T.StructField(score_col, T.DoubleType(), False)])
