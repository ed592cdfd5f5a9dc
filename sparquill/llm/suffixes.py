"""Suffix-array deduplication by distributed prefix doubling.

Every byte string of SIZE bytes that starts at two places or more is removed at all of them.

Sorting every byte position in every round would move twenty bytes for each byte of text, nine times. So the text is
reduced first, to the positions of a synchronising set: a position is in it if, of the REACH + 1 grams of GRAM bytes
that begin within REACH bytes of some place, its gram has the smallest hash. Whether a position is in the set depends on
the bytes near it only, so equal strings have the same positions inside; one position in about 50 is in the set. The
symbol of a position is the string from it to the next.

Prefix doubling ranks these positions: first by their symbols, then by the pair of their own rank and that of the
position 1, 2, 4, ... symbols further on. In each round Spark groups equal pairs; the rank of a group is the
smallest position in it, so ranks are exact names of what they stand for. A position whose rank nobody shares is unique:
it and the longer runs that begin or continue with it go no further. A position is past the threshold when a run twice
as long would leave the windows of SIZE bytes that it stands for: those whose first position REACH bytes or more from
their beginning it is. The two strings of a repeat thus meet in one rank, whatever stands around them.

What is left is to compare the edges. Ranked positions with all windows that they stand for are compared by 128 bits
of all the bytes these cover: where those equal another's, all the windows go. Of equal ones one goes on for all,
and only if its rank has others; the rest are cut in PARTS, twice, down to single windows, by the same rule. Equal
texts count as one throughout, so thousands of copies cost no more than two.

Edge cases: a null or empty text has no bytes; shorter texts than SIZE lose nothing; matches never cross documents; a
string that repeats within one document counts; rows that repeat one another are each other's copies; null ids are
kept. A text of one repeated short unit has every position in the set: all are ranked, none is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, hashing
from .hashing import between

SIZE, GRAM, REACH, PARTS = 400, 12, 96, 10
#: Positions or spans that may be broadcast; more are joined by a shuffle.
BROADCAST_NUMBERS = 4_000_000
_LOW = np.uint64((1 << 28) - 1)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by block prefixes and suffixes."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, 1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def positions(raws: list[bytes], size: int = SIZE, gram: int = GRAM, reach: int = REACH) -> dict[str, np.ndarray]:
    """The synchronising set of the texts, but for the last position of each.

    text (index), i (ordinal), at (position), symbol (hash), n (symbols that each window of the position holds; -1 if it
    stands for none), low and high (how far its windows begin before it).
    """
    ends = hashing.chunk_ends([len(r) for r in raws])
    flat = np.frombuffer(b"".join(raws), np.uint8).astype(np.uint64) + np.uint64(1)
    none = {k: np.zeros(0, np.int64) for k in ("text", "i", "at", "symbol", "n", "low", "high")}
    if len(flat) < size:
        return none
    prefixes = hashing.prefix_hashes(flat)
    place = np.arange(len(flat) - gram + 1)
    least = sliding_least((between(prefixes, place, place + gram) & ~_LOW) | place.astype(np.uint64), reach + 1)
    text = np.repeat(np.arange(len(raws)), np.diff(ends))
    inside = text[: len(least)] == text[reach + gram - 1 :]
    at = np.unique((least[inside] & _LOW).astype(np.int64))
    if len(at) < 2:
        return none
    own = text[at]
    start, stop = ends[own], ends[own + 1]
    first = np.searchsorted(at, start)
    before = np.full(len(at), -1)
    before[1:] = at[:-1]
    begin = np.where(np.arange(len(at)) == first, start, np.maximum(before - reach + 1, start))
    end = np.minimum(at - reach, stop - size)
    n = np.searchsorted(at, np.minimum(at + size - gram - 3 * reach, stop - 1), "right") - 1 - np.arange(len(at))
    n = np.where(begin <= end, n, -1)
    after = np.append(at[1:], at[-1])
    which = np.flatnonzero(np.append(own[1:] == own[:-1], False) | (n >= 0))
    symbol = between(prefixes, at, np.maximum(after, at))
    return {"text": own[which], "i": (np.arange(len(at)) - first)[which], "at": (at - start)[which], "symbol": symbol.view(np.int64)[which], "n": n[which], "low": (at - end)[which], "high": (at - begin)[which]}


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, row: 128 bits of the text."""
    docs = docs.select(common.quoted(id_col).alias("doc_id"), common.quoted(text_col).alias("text"))
    return docs.withColumn("row", F.unhex(F.md5(F.coalesce("text", F.lit("")))))


def _different(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Of docs(doc_id, text, row), long enough: texts (doc, row, copies), and sources (doc, text, copied), a row for each different text."""
    long_ = docs.where(F.octet_length("text") >= size)
    each = long_.groupBy("row", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    texts = each.groupBy("row").agg(F.sum("n").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("one"))
    texts = texts.select(F.monotonically_increasing_id().alias("doc"), "row", "copies", F.col("one.doc_id").alias("id"), F.col("one.n").alias("n"))
    texts = common.stored(texts, "texts")
    found = long_.join(common.small(texts), "row").where(F.col("doc_id").eqNullSafe(F.col("id")))
    shown = [F.col("doc"), F.col("text"), (F.col("copies") > 1).alias("copied"), F.col("n")]
    once, more = found.select(*shown).where("n = 1"), found.select(*shown).where("n > 1").dropDuplicates(["doc"])
    return texts, once.unionByName(more).drop("n")


def _position_table(sources: DataFrame, size: int, gram: int, reach: int) -> DataFrame:
    names = ["doc", "copied", "i", "at", "symbol", "n", "low", "high"]

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, common.SLICE_ROWS):
                part = batch.slice(begin, common.SLICE_ROWS)
                found = positions([t.encode("utf-8", "replace") for t in part.column(1).to_pylist()], size, gram, reach)
                own = [part.column(i).to_numpy(zero_copy_only=False)[found["text"]] for i in (0, 2)]
                small = {k: found[k].astype(np.int32) for k in ("i", "at", "n", "low", "high")}
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*own, small["i"], small["at"], found["symbol"], small["n"], small["low"], small["high"])], names)

    return sources.mapInArrow(run, "doc long, copied boolean, i int, at int, symbol long, n int, low int, high int")


_STATE = ["doc", "copied", "at", "low", "high", "rank"]


def doubled(table: DataFrame) -> DataFrame:
    """Positions(doc, copied, i, at, symbol, n, low, high, id) to those that stand for windows and share their rank with others: (doc, copied, at, low, high, rank)."""
    out = [table.where("n = 0").select(*_STATE[:-1], F.lit(-1).cast("long").alias("rank"))]  # no symbol to rank by
    keys, names = table.withColumnRenamed("symbol", "own").withColumn("next", F.lit(0).cast("long")), ["own", "next"]
    k, used = 0, []
    while True:
        # A rank is the smallest position of its group; groups of one are gone.
        shared = keys.groupBy(*names).agg(F.min("id").alias("rank"), F.count(F.lit(1)).alias("equal")).where("equal > 1").drop("equal")
        ranked = common.stored(keys.join(common.stored(shared, "ranks"), names).drop(*names), f"ranked-{k}")
        out.append(ranked.where((F.col("n") >= 1 << k) & (F.col("n") < 2 << k)).select(*_STATE))
        used.append(ranked)
        if ranked.where(F.col("n") >= 2 << k).isEmpty():
            break
        doc = Window.partitionBy("doc")
        further = F.first("rank").over(doc.orderBy("i").rangeBetween(1 << k, 1 << k))
        keys = ranked.withColumns({"next": further, "most": F.max("n").over(doc)}).where((F.col("most") >= 2 << k) & F.col("next").isNotNull())
        keys, names = keys.drop("most").withColumnRenamed("rank", "own"), ["own", "next"]
        k += 1
    states = out[0]
    for more in out[1:]:
        states = states.unionByName(more)
    states = common.stored(states, "states")
    common.discard(*used)
    return states


def _few(df: DataFrame, column: str) -> DataFrame:
    """df, broadcast if its lists hold few numbers."""
    n = df.agg(F.count(F.lit(1)), F.sum(F.size(column))).first()
    return F.broadcast(df) if n[0] <= BROADCAST_NUMBERS // 8 and (n[1] or 0) <= BROADCAST_NUMBERS else df


def _compared(texts: DataFrame, states: DataFrame, size: int, width: int) -> DataFrame:
    """states(doc, at, low, high, rank, x, y, done) to parts of ``width`` windows.

    rank: hash of the rank so far and of what all windows of the part share; w1, w2: hash of all bytes that its own windows cover, and of
    which these are (0 if that is beyond the text).
    """
    names = ["at", "low", "high", "rank", "x", "y", "done"]
    lists = states.groupBy("doc").agg(F.collect_list(F.struct(*names)).alias("states"))

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                yield _parts(batch.slice(begin, 64), size, width)

    schema = "doc long, at int, low int, high int, x int, y int, done boolean, rank long, w1 long, w2 long"
    return texts.join(lists, "doc").select("doc", F.col("text").cast("binary").alias("raw"), "states").mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, size: int, width: int) -> pa.RecordBatch:
    raw, states = batch.column(1), batch.column(2)
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    own = np.repeat(np.arange(len(raw)), np.diff(states.offsets.to_numpy()))
    at, low, high, rank, x, y, done = (f.to_numpy(zero_copy_only=False) for f in states.flatten().flatten())
    start, n = ends[own], np.diff(ends)[own]
    # The parts of each state that hold a window of its own.
    begin, end = (np.maximum(x, low) - x) // width, (np.minimum(y, high) - x) // width
    count = np.maximum(end - begin + 1, 0)
    k = np.repeat(np.arange(len(at)), count)
    a = x[k] + (np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count) + begin[k]) * width
    b = np.minimum(a + width - 1, y[k])
    inside = (a <= at[k]) & (at[k] + size - b <= n[k])
    k, a, b = k[inside], a[inside], b[inside]
    first, last = at[k] - np.minimum(b, high[k]), at[k] - np.maximum(a, low[k])
    fine = (first >= 0) & (last + size <= n[k])

    def hashes(digest, width: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        data = memoryview(raw.buffers()[2]) if len(k) else b""
        out = b"".join([digest(data[i:j]) for i, j in zip((start[k] + begin).tolist(), (start[k] + end).tolist())])
        return np.frombuffer(out, np.uint64).reshape(-1, width)

    shared = hashes(xxhash.xxh3_64_digest, 1, at[k] - a, at[k] + size - b)[:, 0]
    whole = hashes(xxhash.xxh3_128_digest, 2, np.maximum(first, 0), np.minimum(last + size, n[k]))
    named = hashing.token(rank[k].astype(np.int64), a.astype(np.int64), shared)
    which = hashing.token((at[k] - first).astype(np.int64), (at[k] - last).astype(np.int64))
    w1, w2 = (whole[:, 0] ^ which) * fine, (whole[:, 1] | np.uint64(1)) * fine
    narrow = [pa.array(v.astype(np.int32)) for v in (at[k], low[k], high[k], a, b)]
    columns = [batch.column(0).take(pa.array(own[k])), *narrow, pa.array(done[k]), *[pa.array(v.view(np.int64)) for v in (named, w1, w2)]]
    return pa.RecordBatch.from_arrays(columns, ["doc", "at", "low", "high", "x", "y", "done", "rank", "w1", "w2"])


def _spans(columns) -> list[pa.Array]:
    out = []
    for x in columns[0]:
        pairs = np.array([(p["begin"], p["end"]) for p in x.as_py()], np.int64)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        reach = np.maximum.accumulate(pairs[:, 1])
        new = np.ones(len(pairs), bool)
        new[1:] = pairs[1:, 0] > reach[:-1]
        first = np.flatnonzero(new)
        out.append(np.column_stack([pairs[first, 0], reach[np.append(first[1:], len(pairs)) - 1]]).ravel())
    return [hashing.list_of(out, pa.int32())]


def repeated_spans(docs: DataFrame, size: int = SIZE, gram: int = GRAM, reach: int = REACH) -> DataFrame:
    """docs(doc_id, text, row) to (row, spans): the bytes to remove, as begin, end, begin, end, ..."""
    assert size >= 3 * reach + gram, "a window must hold a position whatever stands around it"
    texts, sources = _different(docs, size)
    table = common.stored(_position_table(sources, size, gram, reach).withColumn("id", F.monotonically_increasing_id()), "positions")
    found = doubled(table)
    common.discard(table)
    states = found.select("doc", "at", "low", "high", "rank", F.lit(reach).alias("x"), F.lit(2 * reach).alias("y"), F.col("copied").alias("done"))
    open_ = common.small(states.select("doc").distinct())
    raws = common.stored(sources.join(open_, "doc", "left_semi").select("doc", "text"), "open-texts")

    removed, width = [], reach + 1
    while True:
        # A state that is done goes on for others only; what it removes is known.
        parts = common.stored(_compared(raws, states, size, width), "parts")
        wholes = parts.groupBy("rank", "w1", "w2").agg(F.count(F.lit(1)).alias("equal"), F.min(F.struct("doc", "at")).alias("one"))
        wholes = common.stored(wholes, "wholes")
        shared = wholes.groupBy("rank").agg(F.sum("equal").alias("n"), F.count(F.lit(1)).alias("kinds")).where("n > 1").drop("n")
        shared = common.stored(wholes.join(shared, "rank"), "shared")
        ranked, parts = parts, parts.join(shared, ["rank", "w1", "w2"])
        equal = (F.col("equal") > 1) & (F.col("w2") != 0)
        goes = F.when(equal, (F.col("kinds") > 1) & (F.col("one") == F.struct("doc", "at"))).otherwise(True)
        parts = parts.withColumns({"fresh": equal & ~F.col("done"), "goes": goes, "done": equal | F.col("done")})
        parts = common.stored(parts.drop("one", "w1", "w2", "equal", "kinds").where("fresh or goes"), "judged")
        common.discard(ranked, wholes, shared)
        removed.append(parts.where("fresh").select("doc", (F.col("at") - F.least("y", "high")).alias("begin"), (F.col("at") - F.greatest("x", "low") + size).alias("end")))
        if width == 1:
            break
        states, width = parts.where("goes").drop("fresh", "goes"), -(-width // PARTS)
    spans = removed[0]
    for more in removed[1:]:
        spans = spans.unionByName(more)
    lists = spans.groupBy("doc").agg(F.collect_set(F.struct("begin", "end")).alias("pairs"))
    out = common.append_arrow(lists, ["pairs"], lambda: _spans, [T.StructField("spans", T.ArrayType(T.IntegerType()))])
    out = out.select("doc", "spans").join(texts.where("copies = 1").select("doc", "row"), "doc").select("row", "spans")
    whole = texts.where("copies > 1").select("row", F.lit(None).cast("array<int>").alias("spans"))
    return common.stored(out.unionByName(whole), "spans")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, reach: int = REACH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (begin, end, ...), kept (binary): one row for each row of docs."""
    docs = _keyed(docs, id_col, text_col)
    spans = repeated_spans(docs, size, gram, reach).withColumn("copied", F.col("spans").isNull())
    rows = docs.join(_few(spans, "spans"), "row", "left")
    whole = F.array(F.lit(0), F.octet_length("text"))
    rows = rows.withColumn("spans", F.when(F.col("copied"), whole).otherwise(F.col("spans"))).drop("copied", "row")
    fields = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType())]

    def make():
        def work(columns):
            n, removed, count, kept = [], [], [], []
            for text, own in zip(columns[0].to_pylist(), columns[1].to_pylist()):
                raw = (text or "").encode("utf-8", "replace")
                cuts = [0, *(own or ()), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                n.append(len(raw))
                removed.append(len(raw) - len(left))
                count.append(len(own or ()) // 2)
                kept.append(left)
            return [pa.array(v, pa.int64()) for v in (n, removed, count)] + [pa.array(kept, pa.binary())]

        return work

    return common.append_arrow(rows, ["text", "spans"], make, fields).select("doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept")
