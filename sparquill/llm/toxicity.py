"""Toxicity by class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has two interpolated Kneser-Ney models: one of order ORDER over the bytes of words, for
expressions that are new but spelt like known ones, and one of order 2 over words, for known words and for expressions of
two words that are ordinary by themselves. The highest orders count each class by itself (words and pairs of words by
the documents that hold them, with a discount of 1). Below them stand continuation counts that both classes share: of
how many different bytes precede a row of bytes, of how many different words precede a word. So an expression that a
class has rarely or never seen is smoothed by what is known of it at all, and cancels out of the comparison. What the
discounts leave for the shared counts is one share for both classes, else unseen words would tell.

The log-likelihoods are compared and normalised by length: over the window of WINDOW words where the ratio is highest,
since a long text may be toxic in a passage only, and over the whole text for ratios that are strong evidence. A
logistic curve, fitted on labelled rows that the counts don't use, maps them to a score.

The counts come from every labelled row of the training part through one aggregation, so they grow with the labels.
The ratios go to the workers by key: no two words or n-grams share one, and an unseen word has the ratio 0. Ratios that
are 0 anyhow (as those of words of one document only) are left out. So these tables grow with the vocabulary of the
labelled rows, on the driver and on each worker.

Edge cases: a text without words has no evidence and the score EMPTY, as has every text without evidence either way;
without labels, or with labels of one class, every score is the share of toxic labels (0.5 without any); null labels
are left out; a document with several labels counts with each; repeated rows are scored alike.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, hashing

ORDER, WINDOW, DISCOUNT, FLOOR, STRONG, EMPTY, FEATURES = 5, 2, 0.75, 60, 4.0, 0.0, 5
#: Labelled rows, about, that fit the curve (of a fifth of the training part, by hash), and words a worker remembers.
CURVE_ROWS, MEMO_WORDS = 20_000, 200_000

_WORD = re.compile(r"[^\W\d_]+")
_LOWER = 8 * (ORDER - 1)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-grams of the words one after another, and how many each word has."""
    pad = b"\x01" * (ORDER - 1)
    raw = [w.encode("utf-8", "replace") for w in words]
    flat = np.frombuffer(b"".join([pad + w + b"\x02" for w in raw]), np.uint8).astype(np.int64)
    sizes = np.array([len(w) + 1 for w in raw], np.int64)
    if not len(sizes):
        return np.zeros(0, np.int64), sizes
    whole = sizes + ORDER - 1
    starts = np.cumsum(whole) - whole
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    packed = np.zeros(len(at), np.int64)
    for i in range(ORDER):
        packed = packed << 8 | flat[at + i]
    return packed, sizes


def word_keys(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) >> 1 for w in words), np.int64, len(words))


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (hashing.mixed(left.view(np.uint64) * hashing.STEP + right.view(np.uint64)) >> np.uint64(1)).view(np.int64)


def count(train: DataFrame) -> DataFrame:
    """train(text, label 0/1) to (kind, key, word, n0, n1) over all rows.

    Kind 0: n-grams of bytes by occurrence. Kind 1: words by document. Kind 2: words and the word after them, by document.
    """

    def run(batches):
        from collections import Counter

        seen, held, pairs = (Counter(), Counter()), (Counter(), Counter()), (Counter(), Counter())

        def table(kind, keys, counts, words=None):
            names = np.concatenate(keys if words is None else [pair_keys(v, w) for v, w in zip(keys, words)])
            _, first, back = np.unique(names, return_index=True, return_inverse=True)
            split, n = len(keys[0]), len(first)
            sums = [np.bincount(back[:split], counts[0], n), np.bincount(back[split:], counts[1], n)]
            second = np.zeros(n, np.int64) if words is None else np.concatenate(words)[first]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.concatenate(keys)[first]), pa.array(second), *[pa.array(x.astype(np.int64)) for x in sums]], ["kind", "key", "word", "n0", "n1"])

        def flush():
            packed = [grams(list(c)) for c in seen]
            numbers = lambda c: np.fromiter(c.values(), np.int64, len(c))
            yield table(0, [p for p, _ in packed], [np.repeat(numbers(c), sizes) for c, (_, sizes) in zip(seen, packed)])
            yield table(1, [word_keys(list(c)) for c in held], [numbers(c) for c in held])
            both = [(word_keys([v for v, _ in c]), word_keys([w for _, w in c])) for c in pairs]
            yield table(2, [v for v, _ in both], [numbers(c) for c in pairs], [w for _, w in both])
            for c in (*seen, *held, *pairs):
                c.clear()

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                seen[label].update(words)
                held[label].update(set(words))
                pairs[label].update(set(zip(words, words[1:])))
                if sum(map(len, (*seen, *pairs))) > MEMO_WORDS:
                    yield from flush()
        yield from flush()

    rows = train.select("text", F.col("label").cast("int")).mapInArrow(run, "kind int, key long, word long, n0 long, n1 long")
    return rows.groupBy("kind", "key", "word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _over(c: int) -> Column:
    """A count beyond the discount of 1: one document alone is no evidence."""
    return F.greatest(F.col(f"n{c}") - 1, F.lit(0))


def _word_ratios(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(kind, key, v): kind 2 words, kind 3 pairs that several toxic documents hold. Any other pair has the ratio of its second word, any other word 0.

    The shared backoff of a word is the number of different words that precede it, and FLOOR more, so that a rare word tells little.
    """
    before = pairs.groupBy(F.col("word").alias("key")).agg(F.count(F.lit(1)).alias("kinds"))
    words = common.stored(words.select("key", "n0", "n1").join(before, "key", "left").withColumn("base", F.coalesce("kinds", F.lit(0)) + FLOOR), "words")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    t = words.agg(*[total(_over(c)).alias(f"over{c}") for c in (0, 1)], total(F.col("n0") + F.col("n1")).alias("all"), total("base").alias("base")).first()
    share = 1 - (t["over0"] + t["over1"]) / max(t["all"], 1)
    likely = lambda c: (1 - share) * _over(c) / float(max(t[f"over{c}"], 1)) + share * F.col("base") / float(max(t["base"], 1))
    words = words.select("key", likely(0).alias("p0"), likely(1).alias("p1"))
    own = words.select("key", F.lit(0).cast("long").alias("word"), F.log(F.col("p1") / F.col("p0")).alias("v"), F.lit(2).alias("kind"))

    both = pairs.groupBy("key").agg(*[F.sum(_over(c)).alias(f"over{c}") for c in (0, 1)], F.sum(F.col("n0") + F.col("n1")).alias("all")).where("over0 + over1 > 0")
    seen = pairs.where(_over(1) > 0).join(both, "key").join(words.withColumnRenamed("key", "word"), "word")
    left = 1 - (F.col("over0") + F.col("over1")) / F.col("all")
    # A class without evidence for a first word keeps the backoff only, as the other class does for a pair that it lacks.
    after = lambda c: (1 - left) * _over(c) / F.greatest(F.col(f"over{c}"), F.lit(1)) + left * F.col(f"p{c}")
    least = F.lit(1e-12)  # of a first word that no pair is left for
    return own.unionByName(seen.select("key", "word", F.log(F.greatest(after(1), least) / F.greatest(after(0), least)).alias("v"), F.lit(3).alias("kind")))


Table = tuple[np.ndarray, np.ndarray]


def ratios(counted: DataFrame) -> tuple[Table, Table, Table, Table]:
    """Log-likelihood ratios as sorted keys and their values: of n-grams, of any other n-gram by its context, of words, and of pairs of words."""
    counts = counted.where("kind = 0").select(F.col("key").alias("gram"), "n0", "n1")
    words = _word_ratios(counted.where("kind = 1"), counted.where("kind = 2"))
    d = DISCOUNT
    # Shared lower orders: how many different bytes precede a gram of k bytes, for k from ORDER - 1 down to 1.
    lower, seen = {}, counts.select(F.col("gram").alias("g"))
    for k in range(ORDER - 1, 0, -1):
        seen = seen.groupBy(F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("g")).agg(F.count(F.lit(1)).alias("n"))
        lower[k] = seen
    # At most 256 rows, against one row of their sum.
    p = lower[1].crossJoin(F.broadcast(lower[1].agg(F.sum("n").alias("all"))))
    p = p.select("g", (F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("all") + d * F.lit(1 / 256)).alias("p"))
    for k in range(2, ORDER):
        context = lower[k].groupBy(F.shiftright("g", 8).alias("h")).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
        own = lower[k].withColumn("h", F.shiftright("g", 8)).join(context, "h").withColumn("s", F.col("g").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
        own = own.join(p.withColumnRenamed("g", "s"), "s")
        p = own.select("g", (F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("all") + d * F.col("kinds") / F.col("all") * F.col("p")).alias("p"))
    context = counts.groupBy(F.shiftright("gram", 8).alias("h")).agg(*[F.sum(f"n{c}").cast("double").alias(f"all{c}") for c in (0, 1)], *[F.sum((F.col(f"n{c}") > 0).cast("double")).alias(f"kinds{c}") for c in (0, 1)])
    left = lambda c: F.when(F.col(f"all{c}") > 0, d * F.col(f"kinds{c}") / F.col(f"all{c}")).otherwise(F.lit(1.0))
    context = context.withColumns({"left0": left(0), "left1": left(1)})
    own = counts.withColumn("h", F.shiftright("gram", 8)).join(context, "h").withColumn("g", F.col("gram").bitwiseAND(F.lit((1 << _LOWER) - 1))).join(p, "g")
    likely = lambda c: F.when(F.col(f"all{c}") > 0, F.greatest(F.col(f"n{c}") - d, F.lit(0.0)) / F.col(f"all{c}")).otherwise(F.lit(0.0)) + F.col(f"left{c}") * F.col("p")
    own = own.select(F.lit(1).alias("kind"), F.col("gram").alias("key"), F.log(likely(1) / likely(0)).alias("v"))
    rest = context.select(F.lit(0).alias("kind"), F.col("h").alias("key"), F.log(F.col("left1") / F.col("left0")).alias("v"))
    rows = own.unionByName(rest).withColumn("word", F.lit(0).cast("long")).unionByName(words).where("v <> 0 or kind in (1, 3)")
    found = rows.select("kind", "key", "word", F.col("v").cast("float").alias("v")).toArrow()  # what has evidence
    kind, key, word, v = (found.column(c).to_numpy() for c in ("kind", "key", "word", "v"))
    out = []
    for k in (1, 0, 2, 3):
        keys = key[kind == k] if k < 3 else pair_keys(key[kind == k], word[kind == k])
        order = np.argsort(keys)
        out.append((keys[order], v[kind == k][order]))
    return tuple(out)


def look_up(table: Table, keys: np.ndarray, other: float) -> np.ndarray:
    """The values of keys, ``other`` for those that the table lacks."""
    known, values = table
    if not len(known):
        return np.full(len(keys), other)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], other).astype(np.float64)


class Scorer:
    """Features of a text: the highest mean ratio of a window by bytes and by words, the mean of the two highest ratios of words, what ratios of words exceed STRONG by, in all, by the logarithm of the length, and the most by which a word tells more after the word before it than by itself."""

    def __init__(self, seen: Table, context: Table, words: Table, pairs: Table):
        self.seen, self.context, self.words, self.pairs = seen, context, words, pairs
        self.maybe = hashing.Filter(26)
        self.maybe.add(pairs[0])
        self.forget()

    def forget(self) -> None:
        """What is known of the words met, by their number: sum and number of the ratios of their bytes, own ratio; key."""
        self.memo, self.each, self.keys = {}, np.zeros((0, 3)), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        packed, sizes = grams(words)
        if not len(sizes):
            return
        known, back = np.unique(packed, return_inverse=True)
        v = look_up(self.seen, known, np.nan)
        v = np.where(np.isnan(v), look_up(self.context, known >> 8, 0.0), v)[back]
        sums = np.add.reduceat(v, np.cumsum(sizes) - sizes)
        keys = word_keys(words)
        self.memo.update(zip(words, range(len(self.keys), len(self.keys) + len(words))))
        self.each = np.vstack([self.each, np.column_stack([sums, sizes, look_up(self.words, keys, 0.0)])])
        self.keys = np.concatenate([self.keys, keys])

    def features(self, texts: list[str | None]) -> np.ndarray:
        rows = [words_of(t) for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.forget()
        self.learn(list({w for r in rows for w in r if w not in self.memo}))
        out = np.zeros((len(rows), FEATURES))
        get = self.memo.__getitem__
        for i, r in enumerate(rows):
            if not r:
                continue
            at = np.fromiter(map(get, r), np.int64, len(r))
            each, keys = self.each[at], self.keys[at]
            pairs = pair_keys(keys[:-1], keys[1:])
            some = np.flatnonzero(self.maybe.has(pairs))
            own = look_up(self.pairs, pairs[some], np.nan)
            after = each[:, 2].copy()
            after[some + 1] = np.where(np.isnan(own), after[some + 1], own)
            sums = np.vstack([np.zeros(3), np.cumsum(each, 0)])
            w = min(WINDOW, len(r))
            part = sums[w:] - sums[:-w]
            top = np.partition(each[:, 2], max(len(r) - 2, 0))[-2:]
            out[i] = (part[:, 0] / part[:, 1]).max(), part[:, 2].max() / w, top.mean(), np.maximum(each[:, 2] - STRONG, 0).sum() / np.log2(2 + len(r)), np.maximum(after - each[:, 2], 0).max()
        return out


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression with a ridge, by Newton steps that are halved until the loss falls: mean and scale of the features, weights with the intercept last."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    held = ridge * np.r_[np.ones(len(w) - 1), 1e-6]

    def loss(w: np.ndarray) -> float:
        t = z @ w
        return float((np.logaddexp(0, t) - y * t).sum() + (held * w * w).sum() / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (y - p) - held * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(held + 1e-9), slope)
        while np.abs(step).max() > 1e-9 and loss(w + step) > loss(w):
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _features(df: DataFrame, tables, text_col: str) -> DataFrame:
    fields = [T.StructField("__features", T.ArrayType(T.DoubleType(), False), False)]

    def make():
        scorer = Scorer(*tables.value)

        def work(columns):
            x = scorer.features(columns[0].to_pylist())
            return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(x.ravel()))]

        return work

    return common.append_arrow(df, [text_col], make, fields)


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """docs(key, text), labels(key, label): counts from the rows whose key hash isn't 0 modulo 5, the curve from the others."""
    spark = docs.sparkSession
    labels = labels.where("label in (0, 1)").select("key", "label").withColumn("__h", F.xxhash64(F.col("key").cast("string"), F.lit(5)))
    fifth = F.pmod("__h", F.lit(5)) == 0
    rest = labels.where(~fifth)
    counts = common.stored(count(docs.join(common.small(rest), "key")), "counts", by="kind")
    tables = spark.sparkContext.broadcast(ratios(counts))
    n = labels.where(fifth).count()
    share = F.pmod(F.xxhash64("__h"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, CURVE_ROWS / max(n, 1)))
    some = docs.join(F.broadcast(labels.where(fifth & share)), "key").select("text", "label")
    rows = _features(some, tables, "text").select("label", "__features").toArrow()
    y = rows.column("label").to_numpy().astype(float)
    model = {"tables": tables, "curve": None, "prior": float(y.mean()) if len(y) else 0.5}
    if 0 < y.sum() < len(y):
        model["curve"] = fit_curve(np.array(rows.column("__features").to_pylist()), y)
    return model


def score(df: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add ``score_col``: how likely the text is toxic, from 0 to 1."""
    out = _features(df.drop(score_col), model["tables"], text_col)
    if model["curve"] is None:
        return out.withColumn(score_col, F.lit(model["prior"])).drop("__features")
    mean, scale, w = model["curve"]
    z = F.lit(float(w[-1]))
    for i in range(len(mean)):
        z = z + F.lit(float(w[i])) * (F.col("__features")[i] - float(mean[i])) / float(scale[i])
    none = F.forall("__features", lambda x: x == 0)
    return out.withColumn(score_col, F.when(none, F.lit(EMPTY)).otherwise(1 / (1 + F.exp(-z)))).drop("__features")
