"""Substring deduplication by recompression.

Words are named by 64-bit hashes. A round names runs of equal symbols by symbol and length, then pairs of a
left and a right symbol (a hash bit of the name deals symbols to the two sides) by both names. A name is a
function of what it stands for, so all tasks give equal runs and pairs the same name in every round, and equal
substrings have the same symbols inside, wherever they stand. Each symbol also carries the range of words that
its existence depends on; at the ends of a document it depends on a word beyond, which no window has.

A window of WINDOW words is keyed by one symbol of the highest round of which its own words determine any, the
one with the smallest hash; if none is, by itself. Equal windows so have equal keys, and neighbouring windows
mostly share one. One aggregation over the keys tells which occur in several documents; only windows with such
keys are compared, by 128-bit hashes of all their words, which verifies the repeat: first runs of windows as wholes,
then single windows of the runs that remain.

Edge cases: a null, empty or blank text has no words; a text shorter than a window loses nothing; rows with a
null id neither lose words nor cost others theirs; rows that repeat an id are judged each by its own words, and
never against one another; repeats within one document stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, hashing
from .hashing import between, mixed

WINDOW, ROUNDS = 13, 2
#: Removed spans that may be broadcast (two numbers each); more are joined by a shuffle.
BROADCAST_SPANS = 2_000_000


class Symbols:
    """Symbols of one round over the words of several texts: names, and the words on which each depends, [low, high)."""

    def __init__(self, name: np.ndarray, low: np.ndarray, high: np.ndarray, text: np.ndarray):
        self.name, self.low, self.high, self.text = name, low, high, text

    def _near(self) -> tuple[np.ndarray, np.ndarray]:
        """low of the symbol before, high of the symbol after; at the ends of a text a word that no window has."""
        same = self.text[1:] == self.text[:-1]
        before, after = np.full(len(self.name), self.low[0] - 1), np.full(len(self.name), self.high[-1] + 1)
        before[1:] = np.where(same, self.low[:-1], self.low[1:] - 1)
        after[:-1] = np.where(same, self.high[1:], self.high[:-1] + 1)
        return before, after

    def runs(self, turn: int) -> Symbols:
        if not len(self.name):
            return self
        before, after = self._near()
        first = np.ones(len(self.name), bool)
        first[1:] = (self.name[1:] != self.name[:-1]) | (self.text[1:] != self.text[:-1])
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(first)) - 1
        size = (end - begin + 1).astype(np.uint64)
        name = np.where(size > 1, mixed(self.name[begin] + size * hashing.OTHER + np.uint64(turn)), self.name[begin])
        return Symbols(name, np.minimum(self.low[begin], before[begin]), np.maximum(self.high[end], after[end]), self.text[begin])

    def pairs(self, turn: int) -> Symbols:
        if not len(self.name):
            return self
        before, after = self._near()
        right = (mixed(self.name ^ np.uint64(turn * 0x51ED27)) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(right), bool)
        joins[:-1] = ~right[:-1] & right[1:] & (self.text[1:] == self.text[:-1])
        second = np.zeros(len(right), bool)
        second[1:] = joins[:-1]
        at = np.flatnonzero(~second)
        pair = joins[at]
        other = np.minimum(at + 1, len(right) - 1)
        name = np.where(pair, mixed(self.name[at] * hashing.STEP + self.name[other] + np.uint64(turn)), self.name[at])
        low = np.where(pair | ~right[at], self.low[at], np.minimum(self.low[at], before[at]))
        high = np.where(pair, self.high[other], np.where(right[at], self.high[at], np.maximum(self.high[at], after[at])))
        return Symbols(name, low, high, self.text[at])


class Windows:
    """Windows of a slice of texts, with their keys and hashes."""

    def __init__(self, texts: list[str | None], size: int = WINDOW):
        rows = [(t or "").encode("utf-8", "replace").split() for t in texts]
        self.ends = hashing.chunk_ends([len(r) for r in rows])
        self.size = size
        words = hashing.word_hashes([w for r in rows for w in r])
        text = np.repeat(np.arange(len(rows)), np.diff(self.ends))
        n = len(words)
        at = np.arange(n)
        self.prefixes, self.others = hashing.prefix_hashes(words), hashing.prefix_hashes(words, hashing.MIX)
        self.begin = at[: max(0, n - size + 1)]
        self.begin = self.begin[text[self.begin] == text[self.begin + size - 1]]
        self.text = text[self.begin]
        levels = [Symbols(words, at, at + 1, text)]
        for turn in range(1, ROUNDS + 1):
            levels.append(levels[-1].runs(turn).pairs(turn))
        self.keys = between(self.prefixes, self.begin, self.begin + size)
        todo = np.arange(len(self.begin))
        for symbols in reversed(levels[1:]):
            if not len(todo):
                break
            found, key = self._choose(symbols, self.begin[todo])
            self.keys[todo[found]] = key
            todo = todo[~found]

    def _choose(self, symbols: Symbols, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the windows determine a symbol, and the keys of those."""
        first = np.searchsorted(symbols.low, begin, "left")
        last = np.searchsorted(symbols.high, begin + self.size, "right") - 1
        found = first <= last
        first, last = first[found], last[found]
        rank = mixed(symbols.name * hashing.OTHER)
        chosen, best = first.copy(), rank[first]
        for k in range(1, int((last - first).max(initial=0)) + 1):
            at = np.minimum(first + k, last)
            better = rank[at] < best
            chosen = np.where(better, at, chosen)
            best = np.where(better, rank[at], best)
        return found, between(self.prefixes, symbols.low[chosen], symbols.high[chosen])

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First window and number of windows of each run of neighbours with one key."""
        if not len(self.begin):
            return self.begin, self.begin
        fresh = np.ones(len(self.keys), bool)
        fresh[1:] = (self.keys[1:] != self.keys[:-1]) | (self.text[1:] != self.text[:-1])
        first = np.flatnonzero(fresh)
        return first, np.diff(np.append(first, len(fresh)))

    def hashes(self, first: np.ndarray, count: np.ndarray | int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the words of ``count`` windows from each of ``first`` on."""
        begin = self.begin[first]
        end = begin + count - 1 + self.size
        return between(self.prefixes, begin, end).view(np.int64), between(self.others, begin, end).view(np.int64)


def _shown(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(common.quoted(id_col).cast("long").alias("doc_id"), common.quoted(text_col).alias("text"))
    return docs.withColumn("row", F.xxhash64("text"))


def _scan(source: DataFrame, size: int, schema: str, rows_of) -> DataFrame:
    """rows_of(windows, batch) for each slice of source, whose columns are doc_id, row, text and what else rows_of reads."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, common.SLICE_ROWS):
                part = batch.slice(at, common.SLICE_ROWS)
                w = Windows(part.column(2).to_pylist(), size)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows_of(w, part)], names)

    return source.mapInArrow(run, schema)


def repeated_keys(source: DataFrame, size: int) -> DataFrame:
    """The keys that stand in several documents."""

    def rows_of(w: Windows, part: pa.RecordBatch) -> list:
        first, _ = w.runs()
        return [w.keys[first].view(np.int64), part.column(0).to_numpy()[w.text[first]]]

    pairs = _scan(source, size, "key long, doc_id long", rows_of)
    return pairs.groupBy("key").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y").select("key")


_RUN = "h1 long, h2 long, key long, doc_id long, row long, at int, n int"


def _run_rows(w: Windows, part: pa.RecordBatch, first: np.ndarray, count: np.ndarray) -> list:
    one, two = w.hashes(first, count)
    text = w.text[first]
    ids, row = part.column(0).to_numpy()[text], part.column(1).to_numpy()[text]
    return [one, two, w.keys[first].view(np.int64), ids, row, (w.begin[first] - w.ends[text]).astype(np.int32), count.astype(np.int32)]


def repeated_runs(source: DataFrame, keys: DataFrame, size: int, most: int) -> DataFrame:
    """Runs of windows whose key stands in several documents, with hashes of all their words."""
    known = hashing.key_filter(keys, most)
    if known is None:
        def all_of(w: Windows, part: pa.RecordBatch) -> list:
            return _run_rows(w, part, *w.runs())

        return _scan(source, size, _RUN, all_of).join(keys, "key", "left_semi")
    shared = source.sparkSession.sparkContext.broadcast(known)

    def rows_of(w: Windows, part: pa.RecordBatch) -> list:
        first, count = w.runs()
        which = shared.value.has(hashing.token(w.keys[first]))
        return _run_rows(w, part, first[which], count[which])

    return _scan(source, size, _RUN, rows_of)


def single_windows(source: DataFrame, runs: DataFrame, sources: DataFrame, size: int, most: int) -> DataFrame:
    """Each window of the runs that are the first of their words, sources(h1, h2, x)."""
    known = hashing.key_filter(sources, most)
    schema = "h1 long, h2 long, doc_id long, row long, at int"

    def parts_of(w: Windows, part: pa.RecordBatch, first: np.ndarray, count: np.ndarray) -> list:
        which = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        one, two, _, ids, row, at, _ = _run_rows(w, part, which, np.ones(len(which), np.int64))
        return [one, two, ids, row, at]

    if known is None:
        own = runs.join(sources, ["h1", "h2"]).where("doc_id = x").groupBy("doc_id", "row").agg(F.collect_set("at").alias("starts"))

        def listed(w: Windows, part: pa.RecordBatch) -> list:
            first, count = w.runs()
            text = w.text[first]
            at = w.begin[first] - w.ends[text]
            wanted = [set(x.as_py()) for x in part.column(3)]
            which = np.fromiter((a in wanted[t] for a, t in zip(at.tolist(), text.tolist())), bool, len(at))
            return parts_of(w, part, first[which], count[which])

        return _scan(source.join(own, ["doc_id", "row"]), size, schema, listed)
    shared = source.sparkSession.sparkContext.broadcast(known)

    def rows_of(w: Windows, part: pa.RecordBatch) -> list:
        first, count = w.runs()
        one, two = w.hashes(first, count)
        which = shared.value.has(hashing.token(one, two, part.column(0).to_numpy()[w.text[first]]))
        return parts_of(w, part, first[which], count[which])

    return _scan(source, size, schema, rows_of)


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Begin, end, begin, end, ... of the union of the ranges."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return np.column_stack([starts[first], reach[np.append(first[1:], len(starts)) - 1]]).ravel()


def repeated_spans(docs: DataFrame, size: int = WINDOW, most_keys: int = hashing.FILTER_KEYS) -> DataFrame:
    """docs(doc_id, text, row) to (doc_id, row, spans): the words to remove, as begin, end, begin, end, ...

    A run of windows whose words are all those of a run in a smaller document goes as a whole. Only the first runs of
    their words, under keys that have runs of different words, are taken apart into windows.
    """
    source = docs.where("doc_id is not null").select("doc_id", "row", "text")
    keys = common.stored(repeated_keys(source, size), "keys")
    runs = common.stored(repeated_runs(source, keys, size, most_keys), "runs")
    least = common.stored(runs.groupBy("h1", "h2").agg(F.min("doc_id").alias("x"), F.first("key").alias("key")), "least")
    several = common.stored(least.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("key"), "several")
    sources = common.stored(least.join(several, "key", "left_semi").select("h1", "h2", "x"), "sources")
    windows = common.stored(single_windows(source, runs, sources, size, most_keys), "windows")
    equal = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y").select("h1", "h2", "x")
    equal = common.stored(equal, "equal")
    later = windows.join(equal, ["h1", "h2"]).where("doc_id > x").select("doc_id", "row", "at", (F.col("at") + size).alias("end"))
    later = common.stored(later, "later")
    whole = runs.join(least.select("h1", "h2", "x"), ["h1", "h2"]).where("doc_id > x").select("doc_id", "row", "at", (F.col("at") + F.col("n") - 1 + size).alias("end"))
    marked = later.unionByName(whole).groupBy("doc_id", "row").agg(F.collect_list("at").alias("starts"), F.collect_list("end").alias("ends"))

    def make():
        return lambda columns: [hashing.list_of([_spans(np.asarray(x.values), np.asarray(y.values)) for x, y in zip(*columns)], pa.int32())]

    out = common.append_arrow(marked, ["starts", "ends"], make, [T.StructField("spans", T.ArrayType(T.IntegerType()))])
    out = common.stored(out.select("doc_id", "row", "spans"), "spans")
    common.discard(keys, runs, least, several, sources, windows, equal, later)
    return out


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with their spans, if any; the spans are broadcast if a count shows them to be few."""
    n = spans.agg(F.count(F.lit(1)), F.sum(F.size("spans"))).first()
    few = n[0] <= BROADCAST_SPANS // 4 and (n[1] or 0) <= 2 * BROADCAST_SPANS
    return docs.join(F.broadcast(spans) if few else spans, ["doc_id", "row"], "left")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, most_keys: int = hashing.FILTER_KEYS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space): one row for each row of docs."""
    docs = _shown(docs, id_col, text_col)
    rows = with_spans(docs, repeated_spans(docs, size, most_keys))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]

    def make():
        def work(columns):
            n, removed, kept = [], [], []
            for text, spans in zip(columns[0].to_pylist(), columns[1].to_pylist()):
                words = (text or "").encode("utf-8", "replace").split()
                left, at = [], 0
                for begin, end in zip(*[iter(spans or ())] * 2):
                    left += words[at:begin]
                    at = end
                left += words[at:]
                n.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8"))
            return [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]

        return work

    return common.append_arrow(rows, ["text", "spans"], make, fields).select("doc_id", "n_words", "n_removed", "kept")
