"""Near-duplicate documents by an LSH forest over MinHash signatures.

TREES sorted orders, each over a row of DEPTHS[-1] MinHash values. A region of a tree is the rows that
share the first DEPTHS[0] values; in it, rows stand in the order of their longer prefixes, so that a row's
neighbours are those of the longest common prefix.

1. Documents of equal shingle sets fall into one class, however many they are; a class is one row below. Sets are equal
   if 128 bits of hash are.
2. Of the neighbours that a row has in all orders, the one met most often is verified on full sets.
   The links so found make components.
3. What is left are pairs of one region but different components, in regions of any size. Pairs of sparse regions
   (SIZES[0] rows at most) are verified one by one. Rows of dense regions are dealt to blocks by their component: a
   component of many rows has blocks of its own, small ones share blocks. Blocks of one and the same component never
   meet, so thousands of near copies and one odd row cost a comparison of that row with each, not a square of pairs. Two
   blocks that meet do so in one task, which returns only the links that join components. No pair is dropped for being
   one of many; in a block, a pair is compared in full unless its signatures agree in six standard deviations less than
   the threshold (a chance of 1e-9).

A pair at the threshold t shares no region with a probability of (1 - t^4)^20, whatever the regions' sizes: 4e-7 at
0.85, 2.7e-5 at 0.8. Longer prefixes order the rows of a region only. Rows of a dense region that are all unlike one
another are still compared block by block, each with each.

Edge cases: a null, empty or blank text has no shingles and is linked with nothing; a text of fewer words
than a shingle has one, its whole row of words; a component's id is its smallest doc_id; repeated rows and
repeated doc_ids each give a row and, having equal sets, one component; null doc_ids are kept and linked like others,
with the component of their near copies (null if none of those has an id); ``root`` names a component whatever its ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, hashing
from .components import components
from .hashing import mixed, word_hashes

#: SIZES: the most rows of a sparse region.
SHINGLE, TREES, DEPTHS, SIZES = 5, 20, (4, 6, 8), (32,)
#: Rows of a block of a dense region.
BLOCK_ROWS = 512

_RANDOM = np.random.default_rng(6)
_MASKS = _RANDOM.integers(0, 1 << 32, TREES * DEPTHS[-1], np.uint32)
_FACTORS = _RANDOM.integers(0, 1 << 31, TREES * DEPTHS[-1], np.uint32) * np.uint32(2) + np.uint32(1)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each row of ``size`` consecutive ones."""
    n = len(hashes) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * hashing.STEP + hashes[i : i + n]
    return mixed(out)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    return np.unique(windows(h, min(size, len(h)))) if len(h) >= size else windows(h, len(h)) + np.uint64(len(h))


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values, one row for each tree."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.empty(len(_MASKS), np.uint32)
    for at in range(0, len(_MASKS), 16):
        out[at : at + 16] = ((low[:, None] ^ _MASKS[at : at + 16]) * _FACTORS[at : at + 16]).min(0)
    return out.reshape(TREES, DEPTHS[-1])


def _keys(values: np.ndarray) -> list[np.ndarray]:
    """For each depth, one key for each tree."""
    state, out = np.arange(1, TREES + 1, dtype=np.uint64), []
    for i in range(DEPTHS[-1]):
        state = mixed(state * hashing.STEP + values[:, i].astype(np.uint64))
        if i + 1 in DEPTHS:
            out.append(state.view(np.int64))
    return out


def _class_of(s: np.ndarray) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(s.tobytes())
    return tuple(np.array([whole >> 64, whole & (1 << 64) - 1], np.uint64).view(np.int64).tolist())


def signatures(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """docs without the text, with n_shingles, h1 and h2 (hashes of the whole set; null if empty), keys (array for each depth)."""
    longs = T.ArrayType(T.LongType(), False)
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())] + [T.StructField(f"k{i}", longs) for i in range(len(DEPTHS))]

    def make():
        def work(columns):
            n, whole, keys, ends = [], [], [[] for _ in DEPTHS], [0]
            for text in columns[0].to_pylist():
                s = shingles(text, size)
                n.append(len(s))
                whole.append(_class_of(s) if len(s) else (None, None))
                if len(s):
                    for into, k in zip(keys, _keys(signature(s))):
                        into.append(k)
                ends.append(ends[-1] + (TREES if len(s) else 0))
            flat = [np.concatenate(k) if k else np.zeros(0, np.int64) for k in keys]
            return [pa.array(n, pa.int64()), *[pa.array([h[i] for h in whole], pa.int64()) for i in (0, 1)]] + [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(k)) for k in flat]

        return work

    return common.append_arrow(docs, [text_col], make, fields).drop(text_col)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """docs(row, text), wanted(node, row) to (node, set)."""
    rows = docs.join(common.small(wanted), "row").select("node", "text")
    fields = [T.StructField("set", T.ArrayType(T.LongType(), False))]

    def make():
        def work(columns):
            found = [shingles(t, size) for t in columns[0].to_pylist()]
            ends = np.cumsum([0] + [len(s) for s in found]).astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]

        return work

    return common.append_arrow(rows, ["text"], make, fields).select("node", "set").dropDuplicates(["node"])


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = common.stored(_sets(docs, ends.join(classes, "node"), size), "sets")
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "set": "left"}), "a").join(sets.withColumnsRenamed({"node": "b", "set": "right"}), "b")

    def make():
        def work(columns):
            left, right = ([x.values.to_numpy().view(np.uint64) for x in c] for c in columns)
            shared = [len(np.intersect1d(x, y, True)) for x, y in zip(left, right)]
            return [pa.array([100 * s >= percent * (len(x) + len(y) - s) for s, x, y in zip(shared, left, right)], pa.bool_())]

        return work

    return common.append_arrow(both, ["left", "right"], make, [T.StructField("similar", T.BooleanType())]).where("similar").select("a", "b")


def _blocks(members: DataFrame) -> DataFrame:
    """members(region, node, root) to (region, node, root, i, j): each row of a block for each pair of blocks it takes part in.

    A root of a quarter of BLOCK_ROWS or more in a region has blocks of its own, named by it; the others' rows share blocks.
    """
    sizes = common.stored(members.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n")), "roots-of-regions")
    large = F.col("n") >= BLOCK_ROWS // 4
    rest = sizes.where(~large).groupBy("region").agg(F.sum("n").alias("rest"))
    many = sizes.where(large)
    rows = members.join(many, ["region", "root"], "left").join(rest, "region", "left")
    parts = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("long")
    own = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("node"), parts("n"))).otherwise(F.pmod(F.xxhash64("root"), parts("rest")))
    rows = rows.select("region", "node", "root", F.when(F.col("n").isNotNull(), F.col("root")).alias("alone"), own.alias("part"))
    rows = common.stored(rows.withColumn("block", F.xxhash64(F.coalesce("alone", F.lit(-1)), "part")), "blocks-of-rows")
    blocks = common.stored(rows.groupBy("region", "block", "alone").agg(F.count(F.lit(1)).alias("n")).drop("n"), "blocks")
    left, right = blocks.withColumnsRenamed({"block": "i", "alone": "x"}), blocks.withColumnsRenamed({"block": "j", "alone": "y"})
    meet = left.join(right, "region").where("i <= j and not coalesce(x = y, false)").select("region", "i", "j")
    meet = meet.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    return rows.join(common.small(meet), ["region", "block"]).drop("alone", "part")


def _dense_links(members: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """members(region, node, root) to links (a, b) that join different roots.

    Each pair of blocks meets in one task, which compares signatures as matrices, then the full sets of pairs that can be
    similar, and returns the links it needs only.
    """
    sets = common.stored(_sets(docs, members.select("node").distinct().join(classes, "node"), size), "sets")
    rows = _blocks(members).join(sets, "node")
    share = percent / 100
    least = share - 6 * (share * (1 - share) / len(_MASKS)) ** 0.5

    def run(rows: pa.Table) -> pa.Table:
        node, root, own = (rows.column(c).to_pylist() for c in ("node", "root", "block"))
        split = rows.column("i")[0] != rows.column("j")[0]
        found = [x.values.to_numpy().view(np.uint64) for x in rows.column("set")]
        signs = np.array([signature(x) for x in found])
        flat, block = signs.reshape(len(found), -1), np.array(own)
        parent = {r: r for r in root}

        def top(r):
            while parent[r] != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r

        links: tuple[list, list] = ([], [])
        for r in range(len(found) - 1):
            equal = flat[r + 1 :] == flat[r]
            near = np.flatnonzero(equal.mean(1) >= least)
            for o in near[np.argsort(-equal[near].sum(1), kind="stable")] + r + 1:
                if top(root[r]) == top(root[o]) or split and block[r] == block[o]:
                    continue
                shared = len(np.intersect1d(found[r], found[o], True))
                if 100 * shared >= percent * (len(found[r]) + len(found[o]) - shared):
                    parent[top(root[r])] = top(root[o])
                    links[0].append(max(node[r], node[o]))
                    links[1].append(min(node[r], node[o]))
        return pa.table({"a": pa.array(links[0], pa.int64()), "b": pa.array(links[1], pa.int64())})

    return rows.groupBy("region", "i", "j").applyInArrow(run, "a long, b long")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row (``common.row_key`` of id and text), root: one row for each row of docs.

    ``percent``: least similarity in hundredths. ``root``: the component's name, null for empty sets.
    """
    docs = docs.select(common.quoted(id_col).alias("doc_id"), common.quoted(text_col).alias("text"))
    docs = docs.withColumn("row", common.row_key(F.col("doc_id"), F.col("text")))
    rows = common.stored(signatures(docs, "text", size), "signatures")
    firsts = [F.first(f"k{i}").alias(f"k{i}") for i in range(len(DEPTHS))]
    classes = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), *firsts)
    classes = common.stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    named = classes.select("node", "row")

    trees = classes.select("node", F.explode(F.arrays_zip("k0", "k1", "k2")).alias("k")).select("node", "k.k0", "k.k1", "k.k2")
    order = Window.partitionBy("k0").orderBy("k1", "k2", "node")
    near = trees.select("node", F.lag("node").over(order).alias("other"), F.count(F.lit(1)).over(Window.partitionBy("k0")).alias("rows"), "k0", "k1", "k2").where("rows > 1")
    near = common.stored(near, "regions")
    met = near.where("other is not null").groupBy(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    sides = met.select(F.col("a").alias("node"), F.struct("times", "a", "b").alias("pair")).unionByName(met.select(F.col("b").alias("node"), F.struct("times", "a", "b").alias("pair")))
    best = sides.groupBy("node").agg(F.max("pair").alias("pair")).select("pair.a", "pair.b").distinct()
    best = common.stored(best, "pairs")
    links = common.stored(verified(best, docs, named, size, percent), "verified")
    roots = components(links)

    # Regions that still hold several components.
    members = near.select("node", F.col("k0").alias("region"), (F.col("rows") > SIZES[0]).alias("dense")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = common.stored(members, "members")
    open_ = members.groupBy("region").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("region")
    members = common.stored(members.join(open_, "region"), "open")
    sparse = members.where("not dense").select("region", "node", "root")
    left, right = sparse.withColumnsRenamed({"node": "a", "root": "x"}), sparse.withColumnsRenamed({"node": "b", "root": "y"})
    rest = left.join(right, "region").where("x < y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = common.stored(rest.join(best, ["a", "b"], "left_anti"), "rest")
    more = common.stored(verified(rest, docs, named, size, percent).unionByName(_dense_links(members.where("dense").select("region", "node", "root"), docs, named, size, percent)), "more")
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    known = classes.select("h1", "h2", "node", "doc_id")
    roots = common.stored(known.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    ids = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = common.stored(roots.join(ids, "root").select("h1", "h2", "root", "component_id"), "ids")
    out = rows.select("doc_id", "n_shingles", "row", "h1", "h2").join(ids, ["h1", "h2"], "left")
    out = out.withColumn("component_id", F.when(F.col("h1").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row", "root")


def kept_rows(groups: DataFrame) -> DataFrame:
    """Of each component of ``group`` the row key of the smallest doc_id (null ids last), and all of empty sets, with how many rows bear it."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    one = groups.where("root is not null").groupBy("root").agg(F.min(first).alias("first")).select("first.row")
    return groups.join(one, "row").unionByName(groups.where("root is null"), allowMissingColumns=True).groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.first("root").alias("root"))
