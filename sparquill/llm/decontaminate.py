"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters and digits, in lower case. A mask is laid on every place of a text; the words under its ones
are hashed, those under its zeros ignored, so a hit survives substitutions there. The two MASKS are chosen so that
every WINDOW words with at most a fifth of them substituted (2 of 13) hold a hit of one of them; shorter items get runs
of words instead, as long as the same guarantee allows. The hashes of documents and benchmark are joined; a hit says
where an item would lie in a document. There the words are compared: all windows of WINDOW words (of the whole item,
if shorter) of which at least PERCENT % are equal make the overlap.

Documents only pass on the hashes that a filter of the benchmark's hashes has; the filter has a fixed size and may let
others through, which the join removes.

Edge cases: null, empty and wordless texts and items overlap with nothing; rows that repeat an id are judged each by its
own words; repeated items are all named; an empty benchmark leaves all clean; null ids are kept; an
item with a null id contaminates like any other, but isn't named or counted among the items.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, hashing

MASKS, WINDOW, PERCENT = ("11101011", "11001111"), 13, 80
FILTER_BITS = 22

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").lower().encode("utf-8", "replace"))


def masks_for(n: int) -> tuple[str, ...]:
    """Masks that an item of n words is indexed by."""
    if n >= WINDOW:
        return MASKS
    wrong = n - -(-PERCENT * n // 100)
    return ("1" * -(-(n - wrong) // (wrong + 1)),) if n else ()


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words under the mask, for each place."""
    places = [i for i, c in enumerate(mask) if c == "1"]
    n = len(words) - len(mask) + 1
    out = np.full(max(n, 0), int(mask, 2) + (len(mask) << 32), np.uint64)
    for i in places:
        out = out * hashing.STEP + words[i : i + n]
    return hashing.mixed(out)


def overlap(document: list[bytes], item: list[bytes], at: int) -> list[tuple[int, int]]:
    """Runs of the document's words that overlap with the item laid at ``at``."""
    n = len(item)
    width = min(WINDOW, n)
    begin, end = max(0, at), min(len(document), at + n)
    if end - begin < width:
        return []
    equal = np.fromiter((a == b for a, b in zip(document[begin:end], item[begin - at : end - at])), np.int64, end - begin)
    sums = np.concatenate([[0], np.cumsum(equal)])
    good = np.flatnonzero(100 * (sums[width:] - sums[:-width]) >= PERCENT * width)
    out: list[tuple[int, int]] = []
    for s in (good + begin).tolist():
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + width)
        else:
            out.append((s, s + width))
    return out


def _index(benchmark: DataFrame) -> DataFrame:
    """benchmark(item, text) to (hash, item, place, mask)."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = hashing.word_hashes(words_of(text))
                for mask in masks_for(len(words)):
                    h = seeds(words, mask).view(np.int64).tolist()
                    for into, v in zip(out, (h, [item] * len(h), range(len(h)), [mask] * len(h))):
                        into.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string())], ["hash", "item", "place", "mask"])

    return benchmark.mapInArrow(run, "hash long, item long, place int, mask string")


def _hits(docs: DataFrame, masks: list[str], known: hashing.Filter | None) -> DataFrame:
    """docs(row, text) to (row, hash, at), for hashes that may be the benchmark's."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, common.SLICE_ROWS):
                part = batch.slice(begin, common.SLICE_ROWS)
                rows = [words_of(t) for t in part.column(1).to_pylist()]
                ends = hashing.chunk_ends([len(r) for r in rows])
                words = hashing.word_hashes([w for r in rows for w in r])
                text = np.repeat(np.arange(len(rows)), np.diff(ends))
                for mask in masks:
                    h = seeds(words, mask)
                    at = np.flatnonzero(shared.value.has(hashing.token(h))) if shared.value is not None else np.arange(len(h))
                    at = at[text[at] == text[at + len(mask) - 1]]
                    own = text[at]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array(h[at].view(np.int64)), pa.array((at - ends[own]).astype(np.int32))], ["row", "hash", "at"])

    return docs.mapInArrow(run, "row binary, hash long, at int")


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(row, item, first_word, last_word): overlaps of documents and items; row is ``common.row_key`` of id and text.

    A seed that many items and documents share lays each of these items on each of these documents; Spark splits the join
    where the seeds are too many to broadcast, and each lie is one narrow row until it is verified.
    """
    items = benchmark.select(common.quoted(item_col).cast("long").alias("item"), common.quoted(item_text_col).alias("item_text"))
    index = common.stored(_index(items), "seeds")
    masks = sorted(r[0] for r in index.select("mask").distinct().collect())  # MASKS, or runs of fewer words than WINDOW
    source = docs.select(common.quoted(id_col).cast("long").alias("id"), common.quoted(text_col).alias("text"))
    source = source.select(common.row_key(F.col("id"), F.col("text")).alias("row"), "text")
    hashes = index.select("hash").distinct()
    n = hashes.count()
    known = None
    if n <= hashing.FILTER_KEYS:
        known = hashing.Filter(FILTER_BITS if n <= 1 << (FILTER_BITS - 4) else hashing.FILTER_BITS)
        known.add(hashing.token(hashes.toArrow().column("hash").to_numpy()))
    hits = _hits(source, masks, known).join(common.small(index.drop("mask")), "hash")
    lies = common.stored(hits.select("row", "item", (F.col("at") - F.col("place")).alias("at")).distinct(), "lies")
    texts = common.small(items.groupBy("item").agg(F.collect_list("item_text").alias("item_texts")).withColumnRenamed("item", "own"))
    wanted = common.stored(lies.join(texts, F.col("item").eqNullSafe(F.col("own"))).drop("own"), "wanted")
    rows = source.join(common.small(lies.select("row").distinct()), "row", "left_semi").dropDuplicates(["row"])
    both = rows.join(wanted, "row")
    run = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    kind = common.to_arrow_type(T.ArrayType(run))

    def make():
        def work(columns):
            out = []
            for text, texts_, at in zip(*[c.to_pylist() for c in columns]):
                document = words_of(text)
                out.append([{"begin": a, "end": b} for t in texts_ for a, b in overlap(document, words_of(t), at)])
            return [pa.array(out, kind)]

        return work

    found = common.append_arrow(both, ["text", "item_texts", "at"], make, [T.StructField("runs", T.ArrayType(run))])
    found = found.select("row", "item", F.explode("runs").alias("r")).select("row", "item", F.col("r.begin").alias("first_word"), (F.col("r.end") - 1).alias("last_word"))
    return common.stored(found.distinct(), "overlaps")


def judge(docs: DataFrame, overlaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with contaminated boolean, n_items long, items array<long>, n_overlap long (words of all items' runs), first_word long."""
    per = overlaps.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"), F.collect_set(F.struct("first_word", "last_word")).alias("runs"), F.min("first_word").alias("first_word"))
    # Words in the union of the runs: sorted by begin, each adds what lies behind the furthest end so far.
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("reach"))
    step = lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), r["last_word"] - F.greatest(a["reach"], r["first_word"] - 1))).alias("n"), F.greatest(a["reach"], r["last_word"]).alias("reach"))
    per = common.stored(per.select("row", "items", F.aggregate(F.array_sort("runs"), start, step)["n"].alias("n_overlap"), "first_word"), "judged")
    names = ["contaminated", "n_items", "items", "n_overlap", "first_word"]
    keep = common.without(docs, names)
    rows = docs.select(*[common.quoted(c) for c in keep], common.row_key(common.quoted(id_col).cast("long"), common.quoted(text_col)).alias("__row"))
    rows = rows.join(common.small(per.withColumnRenamed("row", "__row")), "__row", "left")
    none = F.col("items").isNull()
    return rows.select(
        *[common.quoted(c) for c in keep],
        (~none).alias("contaminated"),
        F.when(none, 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.coalesce("n_overlap", F.lit(0)).cast("long").alias("n_overlap"),
        "first_word",
    )
