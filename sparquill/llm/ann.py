"""Approximate nearest neighbours by stable projections and kd-trees.

Unit vectors are projected on DIMS Gaussian directions (a 2-stable law: the squared projected distance of
two points is their squared distance times a chi-square variable of DIMS degrees). A kd-tree over the
projections gives projected neighbours in growing order; each is verified with its whole vector. A search stops
when a nearer vector, if there were one, would have been projected this far away with a probability below
1 - CONFIDENCE only.

The upper part of the tree is one for the whole table: its cells are cut from the projections of a sample of
SAMPLE_ROWS rows at most, and every vector is routed to its cell. A query first meets its own cell; what it finds
there bounds the cells that the stopping test leaves open, and it meets those only, the lower parts of the tree
(built where a cell's rows lie) stopping by the same test. Cells of many rows, as of a dense region, are dealt to
blocks of about BLOCK_ROWS, and many queries of a cell to pages of about PAGE_ROWS. Of equal vectors only the k + 1
with the smallest ids are compared: no other can be among the k nearest of any query. Where distances hardly
differ (random directions), the test leaves most cells open, and each query meets most of the table in blocks.

Edge cases: null ids, and vectors that are null, empty, zero, or hold null or non-finite components take no part;
very large and very small components are scaled by a power of two, which changes no cosine; only vectors of one length
are compared; a query is never its own neighbour, nor are rows that repeat its id; of several vectors of one query id
the smallest by its components is asked; a neighbour's id with several vectors counts with its nearest; ties go
to the smaller id; fewer candidates than k give all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

DIMS, LEAF, CONFIDENCE, SEED = 8, 32, 0.99, 20
CELL_ROWS, BLOCK_ROWS, PAGE_ROWS = 4096, 8192, 4096
#: Rows, about, whose projections cut the cells; a cell has 16 of them at least.
SAMPLE_ROWS = 50_000


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def chi_square(x: float, dims: int = DIMS) -> float:
    """Distribution function for an even number of degrees."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))


def chi_square_point(p: float, dims: int = DIMS) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < p else (low, mid)
    return high


class Tree:
    """kd-tree over rows of points: leaves of LEAF rows at most, with their bounding boxes."""

    def __init__(self, points: np.ndarray):
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                self.leaves.append(rows)
                continue
            p = points[rows]
            axis = int(np.argmax(p.max(0) - p.min(0)))
            order = np.argpartition(p[:, axis], len(rows) // 2)
            todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        self.low = np.array([points[r].min(0) for r in self.leaves])
        self.high = np.array([points[r].max(0) for r in self.leaves])

    def order(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by growing squared distance of their boxes."""
        d = np.maximum(self.low - point, 0) + np.maximum(point - self.high, 0)
        d = np.einsum("ij,ij->i", d, d)
        at = np.argsort(d, kind="stable")
        return at, d[at]


class Cells:
    """The upper part of the tree: half spaces cut at medians of a sample, down to ``wanted`` cells."""

    def __init__(self, points: np.ndarray, wanted: int):
        self.axis, self.cut, self.kids = [], [], []
        low, high = np.full((1, DIMS), -np.inf), np.full((1, DIMS), np.inf)
        self.low, self.high = [low[0]], [high[0]]
        parts = [(len(points), 0, -1, 0, np.arange(len(points)))]  # size, cell, node above, side, rows
        while len(self.low) < wanted:
            at = max(range(len(parts)), key=lambda i: parts[i][0])
            if parts[at][0] < 32:
                break
            _, cell, above, side, rows = parts.pop(at)
            p = points[rows]
            axis = int(np.argmax(p.max(0) - p.min(0)))
            cut = float(np.median(p[:, axis]))
            right = p[:, axis] >= cut
            if right.all():  # equal points can't be cut
                parts.append((0, cell, above, side, rows[:0]))
                continue
            node, fresh = len(self.axis), len(self.low)
            self.axis.append(axis)
            self.cut.append(cut)
            self.kids.append([-1 - cell, -1 - fresh])
            if above >= 0:
                self.kids[above][side] = node
            self.low.append(self.low[cell].copy())
            self.high.append(self.high[cell].copy())
            self.high[cell] = self.high[cell].copy()
            self.high[cell][axis] = self.low[fresh][axis] = cut
            parts += [(int((~right).sum()), cell, node, 0, rows[~right]), (int(right.sum()), fresh, node, 1, rows[right])]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.axis, self.cut, self.kids = np.array(self.axis, int), np.array(self.cut), np.array(self.kids, int).reshape(-1, 2)

    def route(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), int) if len(self.axis) else np.full(len(points), -1)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            side = points[open_, self.axis[node]] >= self.cut[node]
            at[open_] = self.kids[node, side.astype(int)]
        return -1 - at

    def open_to(self, point: np.ndarray, far: float) -> np.ndarray:
        """Cells with a squared distance of ``far`` at most."""
        d = np.maximum(self.low - point, 0) + np.maximum(point - self.high, 0)
        return np.flatnonzero(np.einsum("ij,ij->i", d, d) <= far)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def projected(x: np.ndarray) -> np.ndarray:
    turn = np.random.default_rng(SEED).standard_normal((x.shape[1], DIMS))
    return (x / np.sqrt((x * x).sum(1))[:, None]) @ turn


def far_of(cosine: np.ndarray | float) -> np.ndarray | float:
    """How far, squared, a vector nearer than this cosine may be projected."""
    return chi_square_point(CONFIDENCE) * np.maximum(0.0, 2 - 2 * cosine) + 1e-12


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[list, list, list]:
    """The k nearest rows of x for each row of q, if nearer than ``bound`` (cosines): lists of query ids, ids, cosines."""
    norms, q_norms = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    tree, points = Tree(projected(x)), projected(q)
    point_99 = chi_square_point(CONFIDENCE)
    out: tuple[list, list, list] = ([], [], [])
    for i, own in enumerate(query_ids):
        at, far = tree.order(points[i])
        best_ids, best = np.zeros(0, ids.dtype), np.zeros(0)
        least = -1.0 if bound is None else bound[i]
        begin, step = 0, 2
        while begin < len(at):
            if far[begin] > point_99 * max(0.0, 2 - 2 * least) + 1e-12:
                break
            rows = np.concatenate([tree.leaves[j] for j in at[begin : begin + step]])
            begin, step = begin + step, min(2 * step, 32)
            rows = rows[ids[rows] != own]
            cosine = (x[rows] * q[i]).sum(1) / (norms[rows] * q_norms[i])
            near = cosine >= least - 1e-9
            best_ids, best = np.concatenate([best_ids, ids[rows[near]]]), np.concatenate([best, cosine[near]])
            keep = np.lexsort((best_ids, -best))
            keep = keep[np.sort(np.unique(best_ids[keep], return_index=True)[1])][:k]  # an id once
            best_ids, best = best_ids[keep], best[keep]
            if len(best) >= k:
                least = max(least, best[k - 1])
        out[0].extend([own] * len(best))
        out[1].extend(best_ids.tolist())
        out[2].extend(best.tolist())
    return out


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return scaled(flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)) if rows else np.zeros((0, 1))


def _by_size(batch: pa.RecordBatch, size_at: int):
    """Row numbers of the batch for each length of vector."""
    sizes = batch.column(size_at).to_numpy()
    for size in np.unique(sizes):
        yield int(size), np.flatnonzero(sizes == size)


def _cells(rows: DataFrame, n: int) -> dict[int, Cells]:
    """The cells for each length of vector that the sample holds; other lengths have one cell."""
    part = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_ROWS / max(n, 1)))
    some = rows.where(part)

    def project(batches):
        for batch in batches:
            for size, at in _by_size(batch, 0):
                points = projected(_matrix(batch.column(1).take(pa.array(at)), len(at)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), DIMS).cast(pa.list_(pa.float64()))], ["size", "point"])

    found = some.select("size", "v").mapInArrow(project, "size int, point array<double>").toArrow()
    sizes, points = found.column("size").to_numpy(), found.column("point").combine_chunks().flatten().to_numpy().reshape(-1, DIMS)
    share = max(1, len(sizes))
    return {int(s): Cells(points[sizes == s], math.ceil(n * int((sizes == s).sum()) / share / CELL_ROWS)) for s in np.unique(sizes)}


def _routed(df: DataFrame, cells) -> DataFrame:
    """df(id, v, size) with the cell of each row."""

    def route(batches):
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            for size, at in _by_size(batch, 2):
                if size in cells.value:
                    cell[at] = cells.value[size].route(projected(_matrix(batch.column(1).take(pa.array(at)), len(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["id", "v", "size", "cell"])

    return df.select("id", "v", "size").mapInArrow(route, "id long, v array<double>, size int, cell int")


def _opened(asked: DataFrame, cells) -> DataFrame:
    """asked(id, v, size, cell, bound) for each cell, but the query's own, that the stopping test leaves open."""
    names = ["id", "v", "size", "cell", "bound"]

    def run(batches):
        for batch in batches:
            for size, at in _by_size(batch, 2):
                if size not in cells.value:
                    continue
                own, bound = batch.column(3).to_numpy()[at], batch.column(4).to_numpy()[at]
                points = projected(_matrix(batch.column(1).take(pa.array(at)), len(at)))
                for begin in range(0, len(at), 256):
                    some = [cells.value[size].open_to(p, far_of(b)) for p, b in zip(points[begin : begin + 256], bound[begin : begin + 256])]
                    some = [c[c != o] for c, o in zip(some, own[begin : begin + 256])]
                    rows = batch.take(pa.array(np.repeat(at[begin : begin + 256], [len(c) for c in some])))
                    for cut in range(0, rows.num_rows, 4096):
                        part = rows.slice(cut, 4096)
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.concatenate(some)[cut : cut + 4096].astype(np.int32)), part.column(4)], names)

    return asked.select(*names).mapInArrow(run, "id long, v array<double>, size int, cell int, bound double")


def _met(rows: DataFrame, asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the k nearest rows of each cell for each query that asks it. A block of a cell and a page of queries meet in one task."""
    n = asked.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("n")).select("size", "cell", F.ceil(F.col("n") / PAGE_ROWS).cast("int").alias("pages"))
    counts = common.small(blocks.join(n, ["size", "cell"]))
    deal = lambda key, of: F.pmod(F.xxhash64(key, "v"), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = rows.join(counts, ["size", "cell"]).withColumn("block", deal("id", "blocks")).withColumn("page", each("pages")).drop("blocks", "pages")
    right = asked.join(counts, ["size", "cell"]).withColumn("page", deal("id", "pages")).withColumn("block", each("blocks")).drop("blocks", "pages")

    def both(x: pa.Table, q: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if x.num_rows and q.num_rows:
            found = search_block(x.column("id").to_numpy(), _matrix(x.column("v"), x.num_rows), q.column("id").to_numpy(), _matrix(q.column("v"), q.num_rows), k, q.column("bound").to_numpy())
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    keys = ["size", "cell", "block", "page"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(both, "query_id long, id long, score double")


def search(index: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), neighbour id under ``id_col``, score (cosine in double precision)."""

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(common.quoted(id_col).cast("long").alias("id"), common.quoted(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
        return df.select("id", F.col("v").cast("array<double>").alias("v"), F.size("v").alias("size"))

    equal = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    rows = clean(index).dropDuplicates(["id", "v"]).withColumn("equal", equal).where(F.col("equal") <= k + 1).drop("equal")
    cells = index.sparkSession.sparkContext.broadcast(_cells(clean(index), index.count()))
    rows = common.stored(_routed(rows, cells), "vectors")
    asked = clean(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("size", F.size("v"))
    asked = common.stored(_routed(asked, cells), "queries")
    blocks = rows.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("n")).select("size", "cell", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    blocks = common.stored(blocks, "blocks")

    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    merged = lambda found: found.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("rank", best).where(F.col("rank") <= k)
    own = common.stored(merged(_met(rows, asked.withColumn("bound", F.lit(-1.0)), blocks, k)), "own-cells")
    bound = own.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    again = asked.join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(-1.0)))
    more = _met(rows, common.stored(_opened(again, cells), "opened"), blocks, k)
    near = merged(own.select("query_id", "id", "score").unionByName(more))
    return near.select("query_id", "rank", F.col("id").alias(id_col), "score")
